"""Pages come back whatever characters their URLs hold."""

from corpusq.llm import warc


def test_control_characters(spark):
    urls = ["http://a.b/x\ty", "http://a.b/x\ny", "http://a.b/x\r\ny", "\t", "http://a.b/\x00\x1f?q=\x0b", "http://a.b/x y", None, "http://a.b/x%09y"]
    p = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.url for r in warc.archive_round_trip(p).collect()}
    assert got == {i: u if u is None else "".join(c if c >= " " else f"%{ord(c):02X}" for c in u) for i, u in enumerate(urls)}
