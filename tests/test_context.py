from corpusq.operators import evaluation
from corpusq.plans import catalog

LONG = "word " * 300


def test_whole_texts_and_headers(spark):
    rows = [(1, 2, LONG, "f.pdf", "imdb", "train", 0.8339, "clean_text"), (1, 1, None, None, None, None, None, None), (1, 3, "x", "", "d", "", 1.0, "")]
    d = spark.createDataFrame(rows, "query_id int, rank int, text string, file string, dataset string, split string, quality double, profile string")
    want = [
        "[Source 1 | Dataset: unknown | Split: unknown]\n\n",
        f"[Source 2 | Dataset: imdb | Split: train | Quality: 0.834 | Profile: clean_text | File: f.pdf]\n{LONG}\n",
        "[Source 3 | Dataset: d | Split:  | Quality: 1.000]\nx\n",
    ]
    assert evaluation.build_context(d).collect()[0].context == "\n---\n".join(want)
    assert evaluation.format_contexts(d).collect()[0].contexts == f"[0] \n[1] {LONG[:600]}...\n[2] x"


def test_query_gives_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, sf, "documents").collect()}
    got = {r.query_id: r.context for r in catalog.build_context(spark, sf).collect()}
    hits = catalog.sparse_topk(spark, sf).collect()
    assert any(len(texts[h.chunk_id]) > 600 for h in hits)
    assert all("]\n" + texts[h.chunk_id] + "\n" in got[h.query_id] for h in hits)
    assert all(f"[Source {h.rank} | Dataset: unknown | Split: unknown | Quality: " in got[h.query_id] for h in hits)
