"""Points rewritten with sparse vectors: each has those of its own text, and terms are different words."""

import duckdb

from corpusq.operators import vectors
from corpusq.plans import catalog

#: Both have the index 2887216208.
A, B = "thintiin", "ouinnt"
DOCUMENTS = [(0, f"{A} {B} {A} Ab ab", "s"), (1, f"{A} x", "s"), (1, f"{B} y y z", None), (2, None, "t"), (3, "--", "t"), (None, "x", "t"), (9, "x", "t")]
EMBEDDINGS = [(0, [0.5, 1.0], 1), (1, [1.0], 1), (2, [], 1), (3, None, 1), (4, [1.0], 1), (None, [1.0], 1)]


def test_agrees_with_sql(spark, tmp_path):
    con = duckdb.connect()
    for name, rows, schema in (("documents", DOCUMENTS, "doc_id long, text string, source string"), ("embeddings", EMBEDDINGS, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["rebuild_with_sparse"])
    got = catalog.queries()["rebuild_with_sparse"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_terms_of_one_index(spark):
    assert len(set(vectors.term_indices([A, B]))) == 1
    d = vectors.with_sparse(spark.createDataFrame([r[:2] for r in DOCUMENTS], "id long, text string"), "text")
    assert d.columns == ["id", "text", "indices", "values", "terms"]
    at = {w: int(vectors.term_indices([w])[0]) for w in (A, "ab", "x", "y", "z")}
    for r in d.collect():
        words = [A if w == B else w for w in (r.text or "").lower().replace("-", " ").split()]
        want = sorted((at[w], words.count(w)) for w in set(words))
        assert (r.indices, r["values"]) == (([i for i, _ in want], [n for _, n in want]) if want else (None, None))
        assert r.terms == len(set((r.text or "").lower().replace("-", " ").split()))
