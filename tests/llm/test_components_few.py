import random

from gridloom.llm import components as C


def test_few_edges_take_no_shuffle_and_many_agree(spark, monkeypatch, capsys):
    """Rounds over few edges wrote a table of nearly empty files each."""
    rng = random.Random(2)
    pairs = [(rng.randrange(-60, 300), rng.randrange(-60, 300)) for _ in range(170)] + [(i, i - 1) for i in range(1000, 1050)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    few = C.components(edges)
    few.explain("simple")
    assert "Exchange" not in capsys.readouterr().out
    one = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(C, "LOCAL", -1)
    assert one == sorted(map(tuple, C.components(edges).collect()))
