"""Operators against brute force, with nulls, empty and repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusq.llm import fingerprints, html, jaccard, licenses, mixing, pieces, quality, repeats, templates, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string"
VOCABULARY = [a + b for a in "the ba na lo ré ti".split() for b in "and s on er ly zu".split()]


def corpus():
    rnd = random.Random(5)
    base = [" ".join(rnd.choices(VOCABULARY, k=rnd.choice([2, 60, 150, 400]))) for _ in range(25)]
    texts = [None, "", "   ", "one", "two words", *base, base[3], base[3], base[7] + "\n" + base[8]]
    for b in base:
        w = b.split()
        for edits in (1, 2, 6):
            v = list(w)
            for _ in range(edits):
                v[rnd.randrange(len(v))] = rnd.choice(VOCABULARY)
            texts.append(" ".join(v))
    return [(i, t, "en", ["a", "b", None][i % 3], 0, "x", "y") for i, t in enumerate(texts)]


def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_repeats(spark):
    rows = corpus()
    data = {r[0]: (r[1] or "").encode() for r in rows}
    count = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    got = {r.doc_id: r for r in repeats.cut_repeats(docs(spark)).collect()}
    assert len(got) == len(rows)
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g), i
        assert len(got[i].spans) == len(re.findall(b"\1+", bytes(gone)))


def test_large_groups_split_by_string(spark, monkeypatch):
    want = {r.doc_id: bytes(r.kept) for r in repeats.cut_repeats(docs(spark)).collect()}
    monkeypatch.setattr(repeats, "GROUP", 1)
    assert {r.doc_id: bytes(r.kept) for r in repeats.cut_repeats(docs(spark)).collect()} == want


def test_near_duplicates(spark):
    sets = {}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark)).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_mix(spark):
    rows = mixing.mix(docs(spark)).collect()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs(spark).repartition(7)).collect()))


def test_fingerprints(spark):
    rows = fingerprints.fingerprints(docs(spark)).collect()
    text = {r[0]: r[1] or "" for r in corpus()}
    for r in rows:
        after = text[(r.doc_id + 1) % len(text)]
        t = text[r.doc_id]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def brute_segmentation(p, word):
    best = [(0.0, [])]
    index = {b.decode(): (i, s) for b, i, s in PIECES(p)}
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + index[word[s:e]][1], best[s][1] + [index[word[s:e]][0]]) for s in range(e) if word[s:e] in index]
        if word[e - 1] not in index:
            options.append((best[e - 1][0] + p.unknown, best[e - 1][1] + [p.byte_id[b] for b in word[e - 1].encode()]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def PIECES(p):
    todo = [("", p.root)]
    while todo:
        text, (to, i, score) = todo.pop()
        if i >= 0:
            yield text.encode(), i, score
        todo += [(text + c, n) for c, n in to.items()]


def test_pieces():
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())
    texts = pa.array(["a  b ▁ x ", "", None, " ", "   ", "ab\n\n c", "漢字😀 test", "internationalisation of theories"])
    ids = pieces.encoded(p, texts)
    assert pieces.decoded(p, ids).to_pylist() == [t or "" for t in texts.to_pylist()]
    for w in (" international", " theories", "  漢字😀x"):
        assert list(p.encode_sorted([w])[w]) == brute_segmentation(p, w)[1]


def test_html():
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>x <b>y</b><br>z<p>w&nbsp;v<script>var a='</p>'</script></article><div class='comments'><p>no</div><footer>f</footer>"
    assert html.main_text(page) == "A & B\nx y z\nw v"


def test_warc(spark):
    rows = [(1, "http://a.b/x", "z" * 200), (2, None, "z" * 200), (3, "http://a.b/", "ab"), (4, "http://c.d", "ab"), (None, "q", None), (5, "http://a.b/x", "é" * 200)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(p).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (2, "response", None), 4: (2, "response", None), None: (0, "response", None), 5: (400, "response", None)}
    assert got[2].payload_digest == hashlib.sha256(b"z" * 200).hexdigest()


def test_recurring_lines_and_licenses(spark):
    rnd = random.Random(1)
    own = lambda: " ".join(rnd.choices(VOCABULARY, k=30))
    rows = [(i, f"{own()}\nPage {i} of the long report\n{own()}\nReleased under the MIT License.", "s") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = templates.drop_recurring(d).collect()
    assert all(r.n_lines == 4 and r.n_dropped == 2 and r.text.count("\n") == 1 for r in cut)
    assert {(r.license, r.containment) for r in licenses.scan(d).collect()} == {("MIT line", 1.0)}
    assert all(r.removed_words == 11 and r.kept for r in quality.quality_rules(d.withColumn("text", F.regexp_replace("text", "[0-9]+", "7"))).collect())


def test_empty_tables(spark):
    d, p = docs(spark).limit(0), spark.createDataFrame([], "page_id long, url string, html string")
    for made in (repeats.cut_repeats(d), jaccard.near_duplicates(d), mixing.mix(d), fingerprints.fingerprints(d), pieces.encode(d), quality.quality_rules(d), templates.drop_recurring(d), licenses.scan(d), html.extract(p), warc.archive_round_trip(p)):
        assert made.count() == 0
