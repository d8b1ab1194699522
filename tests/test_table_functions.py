"""Table functions in SQL against the DataFrame forms."""

from corpusq.functions import tables
from corpusq.functions import text as functions
from corpusq.operators import chunking

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sql_gives_what_the_operators_give(spark):
    assert tables.register(spark) == ["pack_chunks", "adaptive_chunks", "recursive_chunks"]
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, " ")], "doc_id long, text string"), allowMissingColumns=True)
    functions.chunk_params(functions.signals(d)).select("doc_id", "text", "profile", "size", "overlap", "tokens").createOrReplaceTempView("docs")
    got = spark.sql("SELECT doc_id, c.* FROM docs, LATERAL pack_chunks(docs.text, 1200, 180, 500) c")
    assert rows(got) == rows(chunking.pack_chunks(d))
    got = spark.sql("SELECT doc_id, profile, c.* FROM docs, LATERAL adaptive_chunks(docs.text, profile, size, overlap, tokens) c")
    want = rows(chunking.adaptive_chunks(spark.table("docs")))
    assert rows(got) == want and rows(spark.sql("SELECT doc_id, profile, c.* FROM docs, LATERAL adaptive_chunks(docs.text, profile, NULL, NULL, NULL) c")) == want
    got = spark.sql("SELECT doc_id, c.chunk_index, c.chunk_text FROM docs, LATERAL recursive_chunks(docs.text, 1000, 150) c")
    assert rows(got) == rows(chunking.recursive_chunks(d))
    # parameters of each row's own
    got = spark.sql("SELECT doc_id, c.chunk_text FROM docs, LATERAL pack_chunks(docs.text, CASE WHEN doc_id % 2 = 0 THEN 300 ELSE 1200 END, 0, 500) c")
    by = {}
    for i, t in rows(got):
        by.setdefault(i, set()).add(t)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert all(by.get(i, set()) == set(chunking.pack(t, 1200 if i % 2 else 300, 0, 500)) for i, t in texts.items())
