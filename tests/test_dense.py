import duckdb
import numpy as np
import pytest

from corpusq.operators import topk
from corpusq.plans import catalog

SF = "/root/testdata/sf0.001"


def nearest(own):
    ids, v, label = (np.array(x) for x in zip(*duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[], label FROM '{SF}/embeddings.parquet'").fetchall()))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.floor(unit @ unit[i] * 1e6 + 0.5) / 1e6
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -score)) if own or j != i][:10]
    return out, dict(zip(ids.tolist(), label.tolist()))


@pytest.mark.parametrize("block", [7, 2000])
def test_every_query_meets_every_vector(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BROADCAST", 0)
    monkeypatch.setattr(topk, "CHUNKS", block)
    got = {}
    for r in sorted(catalog.dense_topk(spark, SF).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == nearest(True)[0]


def test_summary_leaves_out_own_rows_only(spark):
    hits, label = nearest(False)
    r = catalog.retrieval_summary(spark, SF).collect()[0]
    assert r.n == len(hits) and abs(r.precision - np.mean([sum(label[c] == label[q] for c in h[:5]) / 5 for q, h in hits.items()])) < 1e-4
