import hashlib
import struct
import zlib

import corpus_pipeline as C
from gridloom.llm.tokens import encoder, public_path

from .test_decontamination import brute as leaks
from .test_line_dedup import key
from .test_partenum import brute as classes
from .test_quality_rules import Q, brute as rules

SF = "/root/testdata/sf0.001"


def expected(docs, items):
    def verdict(t):
        return Q.measure([0], [t])["kept"][0] and not rules(t)[5]

    docs = [(i, t or "") for i, t in docs if verdict(t)]
    held = {}
    for i, t in docs:
        for k in {key(x) for x in t.split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    docs = [(i, "\n".join(x for x in t.split("\n") if held.get(key(x), 0) < 10)) for i, t in docs]
    stay = {d for d, _, c in classes(docs, 5, 80, 100) if c == d}
    docs = [(i, t) for i, t in docs if i in stay]
    hit = {i for i, _ in leaks(docs, items)}
    return [(i, t) for i, t in docs if i not in hit]


def test_stages():
    assert [len(s) for s in C.STAGES] == [2] * 5
    assert C.ORACLE_SQL is None


def test_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokenizer = encoder(public_path("word_bpe_49k.json")).tokenizer
    want = []
    for i, t in expected(docs, items):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert 0 < len({g[0] for g in got}) < len(docs)


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.count()
        C.STAGES[-1][1](spark, docs, SF).count()


def test_line_stage_updates_text_and_length(spark):
    rows = [(i, f"own {i}\nShared line", "en", "s", 0) for i in range(12)]
    got = C.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(i, f"own {i}", len(f"own {i}")) for i in range(12)]
    assert hashlib.sha256(got[0].text.encode()).hexdigest()
