"""What the style tree cuts, and what must not be lost."""

import collections
import math
import random
from html.parser import HTMLParser

from corpusq.llm import html

WORDS = [a + b for a in "the ba na lo re ti".split() for b in "and s on er ly zu".split()]


def page(i, article=True):
    rnd = random.Random(i)
    own = [" ".join(rnd.choices(WORDS, k=12)) for _ in range(3)]
    body = "".join(f"<p>{t}</p>" for t in own)
    text = f"<div class='body'>{body}</div>" if not article else f"<article>{body}</article>"
    return f"<body><div class='top'><span>Our site</span></div><div class='x1'><p>All offers of the week</p><p>Call us</p></div>{text}<div class='end'>Made by us</div></body>", "\n".join(own)


def test_templated_host_without_article_elements(spark):
    made = [page(i, False) for i in range(40)]
    rows = [(i, "http://h.example/x", p) for i, (p, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == t for i, (_, t) in enumerate(made))
    assert sum(html.main_text(p) != t for p, t in made) == 40  # without the tree the template stays


def test_no_tree_without_host(spark):
    rows = [(i, u, page(i, False)[0]) for i, u in enumerate([None, "", "no url"] * 6)] + [(None, None, None)] * 2
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 20 and all(r.text.startswith("Our site") for r in got if r.page_id is not None) and sum(r.text == "" for r in got) == 2


def test_names():
    assert html.main_text("<div class='content no-sidebar'><article><p>a b</article></div>") == "a b"
    assert html.main_text("<main><div class='has-sidebar no-menu'>a</div></main>") == "a"
    assert html.main_text("<article><div class='elementor-widget-text'>a</div><div class='article-header'>h</div><p class='notice'>b</p><div class='ad'>no</div></article>") == "a\nh"
    assert html.main_text("<main>x<div class='sidebar'>links</div><div class='menu'>m</div><div class='entry-footer'>f</div><div id='login'>l</div><div class='widget'>w</div></main>") == "x"
    assert html.main_text("<article class='post ad'><p>x</article>") == "x"
    assert html.main_text("<nav><article>menu</article></nav><main>x</main>") == "x"


def test_nothing_is_dropped_for_its_size():
    assert html.main_text("<div class='text'><p>the long main text of the page</p></div><article class=card>teaser</article>") == "the long main text of the page\nteaser"
    assert html.main_text("<p>first part of the article</p><main><p>second part, which is longer than the first</p></main>") == "first part of the article\nsecond part, which is longer than the first"


def test_deep_long_and_broken_pages(spark):
    import time
    import tracemalloc

    tracemalloc.start()
    assert html.main_text('<div class="a">' * 20_000 + "x") == "x" and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    began = time.time()
    for broken in ('<p class="x>' * 8001, "<a x='" * 20_000 + "<b>", "<b>x" * 20_000, "<" * 50_000, "<a " * 50_000, "<!--" * 20_000, "</" * 50_000, "<p>" * 50_000, "<script>" * 9_000, "<li><b>" * 20_000, "<i>" * 20_000 + "</b>" * 20_000):
        html.main_text(broken)
    assert time.time() - began < 20
    assert html.main_text('<p>a</p><p class="x>b</p><p>c</p>') == "a\nb\nc"
    assert html.main_text("a <!-- no --> b <? no ?> c </ no> d") == "a b c d"
    long = "word " * 300_000
    rows = [(1, "http://h/a", f"<p>{long}</p>", "t", 1), (None, "http://h/a", None, "t", 1), (None, None, "", "t", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", len(long) - 1), ("None", 0), ("None", 0)]


class Dom(HTMLParser):
    """Well-formed pages as nested lists [path, text, children]."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["", "", [], None]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        names = "".join(f".{v}" for k, v in attrs if k == "class")
        self.at[2].append([f"{self.at[0]}/{tag}{names}", "", [], self.at])
        self.at = self.at[2][-1]

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[1] += data


def style_tree(pages, low=0.3, gamma=0.9, least=5, share=0.9):
    """The slow way: all elements of all pages by path, entropies over lists, composite importance by recursion."""
    doms = {p: Dom(p).root for p in set(pages)}
    style, text = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(lambda: collections.defaultdict(set))

    def visit(page, e):
        tags = [c[0].rsplit("/", 1)[1].split(".")[0] for c in e[2]]
        style[e[0]][page].append(tuple(dict.fromkeys(tags)))
        if e[1].strip():
            text[e[0]][e[1].strip()].add(page)
        for c in e[2]:
            visit(page, c)

    for p, d in doms.items():
        visit(p, d)

    def presentation(path):
        kinds = collections.Counter(map(tuple, style[path].values()))
        m = sum(kinds.values())
        return -sum(n / m * math.log(n / m, m) for n in kinds.values()) if m >= least else 1.0

    def content(path):
        m = len(style[path])
        if m < least:
            return 1.0
        n = {t: len(p) for t, p in text[path].items()}
        return sum(k * (1 - math.log(k, m)) for k in n.values()) / sum(n.values())

    def composite(e):
        """(importance, whether all is noise) or None without text."""
        below = [x for x in map(composite, e[2]) if x]
        own = content(e[0]) if len(text[e[0]][e[1].strip()]) >= least else 1.0
        parts = [x[0] for x in below] + ([own] if e[1].strip() else [])
        if not parts:
            return None
        value = (1 - gamma) * presentation(e[0]) + gamma * sum(parts) / len(parts)
        return value, value < low and all(x[1] for x in below)

    def kept(e, article):
        article = article or e[0].rsplit("/", 1)[-1].split(".")[0] in ("article", "main")
        t, m = e[1].strip(), len(style[e[0]])
        common = t and m >= least and len(text[e[0]][t]) >= max(least, share * m)
        out = [t] if t and (article or not composite(e)[1] and not common) else []
        return out + [x for c in e[2] for x in kept(c, article)]

    return {p: "\n".join(kept(d, False)) for p, d in doms.items()}


def test_tree_against_a_slow_one(spark):
    rnd = random.Random(31)
    rows, want = [], {}
    for host in range(3):
        pages = []
        for i in range([40, 12, 25][host]):
            own = lambda: " ".join(rnd.choices(WORDS, k=9))
            links = "".join(f"<li>{rnd.choice(['Home', 'News', 'About', 'Shop', own()])}</li>" for _ in range(rnd.randrange(4)))
            body = "".join(f"<p>{own() if rnd.random() < 0.7 else 'Said again and again.'}</p>" for _ in range(rnd.randrange(1, 4)))
            body = f"<article>{body}</article>" if host == 2 and i % 2 else f"<div class='body'>{body}</div>"
            box = f"<section class='box'><h2>{rnd.choice(['Offers', 'Offers', own()])}</h2><div><span>{rnd.choice(['Buy', 'Buy', 'Buy', own()])}</span></div></section>"
            pages.append(f"<html><body><div class='top'>Our site</div><ul class='list'>{links}</ul>{box if rnd.random() < 0.8 else ''}{body}<div class='end'><b>{'Made by us' if host else own()}</b></div></body></html>")
        pages += pages[:3] * 4
        want |= {(host, p): t for p, t in style_tree(pages).items()}
        rows += [(host, f"http://h{host}.x/{k}", p) for k, p in enumerate(pages)]
    got = html.extract(spark.createDataFrame([(k, u, p) for k, (_, u, p) in enumerate(rows)], "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.text == want[rows[r.page_id][0], rows[r.page_id][2]] for r in got)
    assert sum(html.main_text(p) != want[h, p] for h, _, p in rows) > 60  # where the tree decides, not the kinds
