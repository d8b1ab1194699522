"""Copies of a page are no evidence of boilerplate."""

from corpusq.llm import html

PAGE = "<html><body><div class='top'>Site {}</div><article><h1>{}</h1><p>{}</p><p>The same last words.</p></article><div class='end'>All rights</div></body></html>"


def texts(spark, pages):
    d = spark.createDataFrame([(i, "http://h.x/" + str(i), p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(d.repartition(3)).collect()}


def test_host_of_copies(spark):
    got = texts(spark, [PAGE.format("", "Title", "A story.")] * 12)
    assert set(got.values()) == {"Site\nTitle\nA story.\nThe same last words.\nAll rights"}  # one page is no evidence


def test_group_of_copies_among_others(spark):
    pages = [PAGE.format("", "Title", "A story.")] * 60 + [PAGE.format("", f"Title {i}", f"Story {i}.") for i in range(8)]
    got = texts(spark, pages)
    # "Site" and "All rights" go; in the article nothing does
    assert all(got[i] == "Title\nA story.\nThe same last words." for i in range(60))
    assert all(got[60 + i] == f"Title {i}\nStory {i}.\nThe same last words." for i in range(8))


def test_own_text_stays_beside_common_texts_of_its_path(spark):
    own = "".join(f"<p>Common line {k}.</p>" for k in range(20))
    pages = [f"<article><p>Story {i}.</p>{own}</article>" for i in range(30)]
    assert texts(spark, pages) == {i: "\n".join([f"Story {i}.", *(f"Common line {k}." for k in range(20))]) for i in range(30)}
    outside = [p.replace("article>", "div>") for p in pages]
    assert texts(spark, outside) == {i: f"Story {i}." for i in range(30)}


def test_quoted_line_stays(spark):
    pages = [PAGE.format("", f"Title {i}", "A common quote." if i < 80 else f"Story {i}.") for i in range(100)]
    got = texts(spark, pages)
    assert got[3] == "Title 3\nA common quote.\nThe same last words."
