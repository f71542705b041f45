"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality rules: documents the rules reject go;
2. line dedup: lines that ten or more documents hold go from every document, ``n_chars`` follows;
3. n-gram Jaccard join: of each class of near copies (five-word shingles, similarity 0.8) the document
   with the smallest id stays; rows with equal ids stay or go together, each row without an id
   is a document of its own and comes after those with one;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: token pieces of what is left, in sequences of at most 4096 tokens.

Null and empty texts are rejected by the first stage. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, line_dedup, packing, partenum, quality_rules
from gridloom.llm.rows import scratch_path
from gridloom.llm.tokens import public_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules keep, with all their columns. Null and empty texts go; repeated rows share a verdict."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that ten or more documents hold; ``n_chars`` is the length of what is left. Null text becomes empty."""
    kept, _ = line_dedup.dedup(docs, min_docs=10, by_id=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id, with all its rows; a row without an id is a document of its own and comes last."""
    node = partenum.free_name(docs)
    rows, _ = partenum.with_nodes(docs, node)
    classes = partenum.node_classes(rows.select(F.col(node).alias("doc_id"), "text"), k=5, num=80, den=100)
    return rows.join(classes.where("component_id = doc_id").select(F.col("doc_id").alias(node)).distinct(), node, "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that shares four fifths of an item of ``benchmark``; all rows of an id go together."""
    node = partenum.free_name(docs)
    rows, _ = partenum.with_nodes(docs, node)
    found = decontamination.leaks(rows.select(F.col(node).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8)
    return rows.join(found.select(F.col("doc_id").alias(node)).distinct(), node, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packed),
]

#: SQL cannot tokenise; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
