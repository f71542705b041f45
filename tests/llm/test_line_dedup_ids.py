import corpus_pipeline as C
from gridloom.llm import line_dedup as L

from .test_line_dedup import brute, result


def test_a_repeated_row_is_one_document(spark):
    docs = [(1, "own line\nshared")] * 12 + [(1, "other text\nshared")] + [(i, f"l{i}\nshared") for i in range(2, 10)]
    docs += [(None, "no id\nbare")] * 10
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same = brute(list(dict.fromkeys(docs[:-10])), 11)  # nine ids hold the shared line
    got = result(L.dedup(frame, 10, by_id=True)[0])
    assert [r for r in got if r[0] is not None] == sorted(r for i, t in docs[:-10] for r in brute([(i, t)], 11))
    assert {r for r in got if r[0] is not None} == set(same)
    assert {r[1:3] for r in got if r[0] is None} == {(2, 2)}
    assert sorted(r.text for r in C.lines(spark, frame.where("doc_id = 1"), "").collect()) == sorted(t for i, t in docs if i == 1)
