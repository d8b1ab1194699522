"""Percentiles of large groups by ranges, against sorting."""

import random

from corpusq.operators import evaluation


def test_large_groups_with_ties(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SMALL", 1000)
    rnd = random.Random(1)
    rows = [("hot", rnd.lognormvariate(0, 3)) for _ in range(60_000)] + [("tied", float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(20_000)]
    rows += [("small", rnd.random()) for _ in range(500)] + [(None, rnd.random()) for _ in range(3000)] + [("one", 5.0), ("none", None), ("same", 3.0), ("same", 3.0)]
    shares = (0.0, 0.5, 0.9, 0.99, 0.999)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = (len(v), *(v[int(len(v) * p)] for p in shares))
    got = {r.g: tuple(r)[1:] for r in evaluation.latency_percentiles(df, "g", "v", shares).collect()}
    assert got == want
    sorted_ = evaluation.in_ranges(df.where("g = 'hot'"), "g", "v", shares[1:]).count()
    assert sorted_ < 0.01 * 60_000
