import os

import duckdb
import pytest

from corpusq.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "events", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_packed_chunks(spark):
    from corpusq.operators import chunking

    rows = [(1, "One two. Three four. Five six."), (2, None), (3, "abcdefghijklmnopqrstuvwxyz"), (4, "  \n \n "), (5, "aa bb cc dd ee ff gg")]
    got = chunking.pack_chunks(spark.createDataFrame(rows, "doc_id long, text string"), size=12, overlap=4, tokens=9).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.doc_id, []).append(r.chunk_text)
    assert by == {
        1: ["One two.", "two. Three four.", "our. Five six."],
        3: ["abcdefghijkl", "ijkl ijklmnopqrst", "qrst qrstuvwxyz", "wxyz yz"],
        5: ["aa bb cc dd", "c dd ee ff gg"],
    }


def test_mean_by_leaves_out_nan(spark):
    from corpusq.operators import evaluation

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", float("nan"))], "metric string, score double")
    got = {r.metric: (r.mean, r.std, r.n_nan) for r in evaluation.mean_by(df, "metric", "score").collect()}
    assert got == {"a": (2.0, 1.0, 1), "b": (None, None, 1)}
