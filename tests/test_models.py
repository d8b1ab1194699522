"""Rerankers by name."""

import pytest

from corpusq.operators import models

HITS = [(1, "red fox", "a", "the red fox and the red hen", 0.9), (1, "red fox", "b", "a fox", 0.8), (1, "red fox", "c", None, 0.7), (2, None, "a", "text", 0.5), (2, None, "b", "more", 0.4)]
SCHEMA = "query_id int, query string, chunk_id string, text string, score double"


def ranked(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score, r.cosine_score) for r in df.collect())


def test_two_models(spark):
    d = spark.createDataFrame(HITS, SCHEMA)
    assert ranked(models.rerank_by(d, 2)) == [(1, 1, "a", 1.0, 0.9), (1, 2, "b", 0.5, 0.8), (2, 1, "a", 0.0, 0.5), (2, 2, "b", 0.0, 0.4)]
    got = ranked(models.rerank_by(d, 3, "shared-counts", batch=1))
    assert [(r[0], r[2]) for r in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")]
    assert got[0][3] == 1.0 and 0 < got[1][3] < 1 and got[2][3] == 0.0 and got[3][3] == got[4][3] == 0.5
    assert models.rerank_by(d.limit(0), 3).count() == 0


def test_own_and_failing_models(spark, tmp_path):
    d = spark.createDataFrame(HITS * 40, SCHEMA).repartition(2)
    own, folder = models.Registry("reranker"), str(tmp_path)

    def loaded():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda q, t: [float(len(x)) for x in t]

    own.register("length", loaded)
    own.register("short", lambda: lambda q, t: [1.0])
    own.register("nan", lambda: lambda q, t: [float("nan")] * len(q))
    assert models.rerank_by(d, 3, "length", own, batch=7).count() == 6
    assert 1 <= len(list(tmp_path.iterdir())) <= 2  # once a task, not once a batch
    with pytest.raises(ValueError, match="unknown reranker none; there are length, nan, short"):
        models.rerank_by(d, 3, "none", own)
    for bad in ("short", "nan"):
        with pytest.raises(Exception, match="scores for"):
            models.rerank_by(d, 3, bad, own, batch=7).collect()


def test_equal_scores(spark):
    d = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 1.0), (2, 5.0)], "query_id int, score double")
    value = lambda **how: sorted(r.score for r in models.normalized(d, **how).collect())
    assert value(bounded=True) == [1.0, 3.0, 3.0, 5.0] and value(bounded=False) == [0.0, 0.5, 0.5, 1.0] and value(bounded=False, equal=None) == [0.0, 1.0, 3.0, 3.0]
