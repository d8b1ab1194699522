import hashlib

from corpusq.llm import warc


def test_repeated_ids_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRIPE", 4000)
    monkeypatch.setattr(warc, "GAP", 100)
    rows = [(1, "http://a.b/x", "z" * 300, 0), (2, "http://a.b/y", "z" * 300, 0), (2, "http://a.b/z", "unique " * 50, 0), (3, "http://a.b/x", "long " * 40000, 0)]
    rows += [(i, f"http://h{i % 7}.example/{i}", f"page {i} " * 30, 0) for i in range(10, 400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(d).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((i, sha(t), "revisit" if i == 2 and t[0] == "z" else "response", 1 if i == 2 and t[0] == "z" else None) for i, _, t, _ in rows)


def test_runs():
    assert list(warc.runs_of([(0, 10), (10, 5), (15 + warc.GAP + 1, 3)])) == [(0, 15, [(0, 10), (10, 5)]), (15 + warc.GAP + 1, 15 + warc.GAP + 4, [(15 + warc.GAP + 1, 3)])]
