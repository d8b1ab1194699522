"""Dense, sparse and approximate top-k against plain numpy and Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusq import shared
from corpusq.operators import ann, retrieval, topk


def vectors(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) if not clusters else rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] * 4 + rng.normal(size=(n, dims))
    return v.round(3)


def frame(spark, ids, v, key):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in zip(ids, v)], f"{key} long, v array<float>")


def nearest(q, c, k, own=True, threshold=None):
    out = []
    unit = lambda x: np.asarray(x, np.float32).astype(float) / np.linalg.norm(np.asarray(x, np.float32).astype(float))
    for i, x in q:
        s = sorted((-np.floor(unit(x) @ unit(y) * 1e6 + 0.5) / 1e6, j) for j, y in c if own or i != j)
        out += [(i, j, -a, r + 1) for r, (a, j) in enumerate([p for p in s if threshold is None or -p[0] >= threshold][:k])]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
@pytest.mark.parametrize("how", [{}, {"own": False}, {"threshold": 0.1}])
def test_dense(spark, monkeypatch, broadcast, how):
    for name, x in (("BROADCAST", broadcast), ("QUERIES", 7), ("CHUNKS", 50), ("SCORES", 400)):
        monkeypatch.setattr(topk, name, x)
    v = list(vectors(300, 8, 1))
    v[50:60] = [v[0]] * 10  # ties
    d = frame(spark, range(300), v, "chunk_id").repartition(3)
    odd = frame(spark, [900, 901, 902], [None, [0.0] * 8, [1.0]], "chunk_id")
    q = d.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = retrieval.dense_topk(q, d.unionByName(odd), 10, **how).select("query_id", "chunk_id", "score", "rank").collect()
    want = nearest([(i, v[i]) for i in range(0, 300, 20)], list(enumerate(v)), 10, **how)
    assert [tuple(r)[:2] + tuple(r)[3:] for r in sorted(map(tuple, got))] == [r[:2] + r[3:] for r in want]
    assert np.allclose([r[2] for r in sorted(map(tuple, got))], [r[2] for r in want], atol=2e-6)


def test_dense_of_nothing_and_of_mixed_queries(spark):
    none, one = frame(spark, [], [], "query_id"), frame(spark, [1], [[1.0, 2.0]], "chunk_id")
    assert retrieval.dense_topk(none, one, 3).count() == 0
    assert retrieval.dense_topk(one.withColumnRenamed("chunk_id", "query_id"), none.withColumnRenamed("query_id", "chunk_id"), 3).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.dense_topk(frame(spark, [1, 2], [[1.0], [1.0, 2.0]], "query_id"), one, 3)


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [" ".join(rnd.choices(words, weights, k=rnd.choice([3, 20, 20, 60, 400]))) for _ in range(n)]


def best_by_words(q, c, k, once):
    count = lambda t: collections.Counter(re.findall(r"[^\W_]+", (t or "").lower()))
    own = [(j, count(t)) for j, t in c]
    out = []
    for i, t in q:
        a = count(t)
        s = sorted((-sum((1 if once else n * b[w]) for w, n in a.items() if w in b), j) for j, b in own)
        out += [(i, j, float(-x), r + 1) for r, (x, j) in enumerate([p for p in s if p[0] < 0][:k])]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
@pytest.mark.parametrize("once", [False, True])
def test_sparse(spark, monkeypatch, broadcast, once):
    for name, x in (("BROADCAST", broadcast), ("QUERIES", 5), ("CHUNKS", 200), ("BOUND", 16)):
        monkeypatch.setattr(topk, name, x)
    c = list(enumerate(texts(600, 2))) + [(900, None), (901, ""), (902, "...")]
    q = [(i, t[:100]) for i, t in c[:600:40]] + [(700, None), (701, "unheard of")]
    a, b = spark.createDataFrame(q, "query_id long, text string"), spark.createDataFrame(c, "chunk_id long, text string").repartition(3)
    got = retrieval.sparse_topk(a, b, 10, once).select("query_id", "chunk_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == best_by_words(q, c, 10, once)


def test_blocks_are_skipped_without_loss():
    c, q = texts(4000, 3), texts(20, 4)
    words = lambda t: pa.array([x.split() for x in t])
    s = topk.Sparse(pa.table({"query_id": pa.array(range(20)), "words": words(q)}), pa.int64(), 10)
    for a in range(0, 4000, 2000):
        s.add(pa.array(range(a, a + 2000)), words(c[a : a + 2000]))
    assert s.blocks == 20 * 16 and s.skipped > s.blocks // 2
    got = s.best.table().to_pydict()
    assert sorted(zip(got["query_id"], got["chunk_id"], got["score"])) == [r[:3] for r in best_by_words(list(enumerate(q)), list(enumerate(c)), 10, False)]


def test_index_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNKS", 100)
    monkeypatch.setattr(topk, "QUERIES", 30)
    v = vectors(4000, 16, 5, clusters=80)
    d = frame(spark, range(4000), v, "chunk_id").repartition(4)
    q = d.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(d.unionByName(frame(spark, [9000, 9001], [None, [0.0] * 16], "chunk_id")), shared.new_path(spark, "test-cells"))
    assert spark.read.parquet(f"{index.path}/vectors").count() == 4000
    got = ann.ann_topk(q, index, 10).select("query_id", "chunk_id", "score", "rank").collect()
    want = retrieval.dense_topk(q, d, 10).select("query_id", "chunk_id", "score").collect()
    assert len(got) == 2000 and {r.query_id for r in got} == set(range(0, 4000, 20))
    exact = {(r.query_id, r.chunk_id): r.score for r in want}
    found = [r for r in got if (r.query_id, r.chunk_id) in exact]
    assert len(found) >= 0.9 * len(want) and all(r.score == exact[r.query_id, r.chunk_id] for r in found)
    assert ann.candidates(q, index) <= 0.1 * 200 * 4000


def test_index_on_vectors_that_fill_the_space(spark):
    """No cell holds the neighbours of such vectors: the probes are set so that recall is kept."""
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding AS v")
    q = d.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(d, shared.new_path(spark, "test-cells"))
    got = {(r.query_id, r.chunk_id) for r in ann.ann_topk(q, index, 10).collect()}
    want = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(q, d, 10).collect()}
    assert len(got & want) >= 0.9 * len(want) and ann.candidates(q, index) < 0.9 * q.count() * d.count()


def test_empty_index(spark):
    index = ann.build(frame(spark, [], [], "chunk_id"), shared.new_path(spark, "test-cells"))
    assert ann.ann_topk(frame(spark, [1], [[1.0]], "query_id"), index, 3).count() == 0


def test_candidates_are_sorted_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(topk, "FOUND", 500)
    monkeypatch.setattr(topk, "WORDS", 3000)
    r = random.Random(3)
    words = [[f"w{r.randrange(40)}" for _ in range(r.randrange(12))] for _ in range(1500)]
    queries = pa.table({"query_id": pa.array(range(200)), "words": pa.array(words[:200])})
    s, lots = topk.Sparse(queries, pa.int64(), 5), []
    add = s.best.add
    monkeypatch.setattr(s.best, "add", lambda q, score, ids: (lots.append(len(q)), add(q, score, ids)))
    s.add(pa.array(range(1500)), pa.array(words))
    assert max(lots) <= 500 + topk.BOUND
    got = {}
    for h in s.best.table().to_pylist():
        got.setdefault(h["query_id"], []).append((-h["score"], h["chunk_id"]))
    for q in range(200):
        scores = sorted((-sum(words[q].count(w) * words[c].count(w) for w in set(words[q])), c) for c in range(1500))
        assert sorted(got.get(q, [])) == [x for x in scores if x[0]][:5]
