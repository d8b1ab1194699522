"""Nulls, repeated ids, very long texts, ties and clashing columns, each with its stated result."""

import random

from corpusq.llm import jaccard, licenses, mixing, pieces, quality, repeats, templates

WORDS = [a + b for a in "the ba na lo re ti".split() for b in "and s on er ly zu".split()]
FOOT = "All rights to this text are kept"


def own(rnd, n=60):
    return " ".join(rnd.choices(WORDS, k=n))


def test_null_and_repeated_ids_lose_their_own_lines(spark):
    rnd = random.Random(8)
    rows = [(i if i < 30 else None if i < 34 else 5, f"{own(rnd)}\n{FOOT}" if i != 35 else own(rnd), "h", "x", "y", 1, 2) for i in range(36)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, removed_words string, kept string, n_dropped int, __row int").repartition(3)
    judged = quality.quality_rules(d).collect()
    assert len(judged) == 36 and sorted(r.removed_words for r in judged) == [0] + [7] * 35
    kept = quality.cleaned(d)
    assert kept.columns == d.columns
    got = kept.collect()
    assert len(got) == 36 and all(FOOT not in r.text and r.removed_words == "x" and r.kept == "y" for r in got)
    cut = templates.drop_recurring(d)
    assert cut.columns.count("n_dropped") == 1
    assert sorted(r.n_dropped for r in cut.collect()) == [0] + [1] * 35


def test_rules_by_distinct_documents_of_a_host(spark):
    rnd = random.Random(9)
    block = "First line of the foot\nSecond line of the foot\nThird line of the foot"
    rows = [(i, f"{own(rnd)}\n{block}", "a") for i in range(40)] + [(100, "\n".join(f"{own(rnd, 9)}\nonce more" for _ in range(60)), "b")] + [(200 + i, own(rnd), "b") for i in range(30)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 15 and got[i].kept for i in range(40))
    assert got[100].removed_words == 0


def test_licenses_of_rows_without_id(spark):
    rows = [(1, "x y Released under the MIT License. z"), (None, "x y Released under the MIT License. z"), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "MIT line"), ("None", "MIT line")]


def test_license_recall_on_damaged_copies(spark):
    rnd, rows = random.Random(10), []
    for name, body in licenses.TEMPLATES.items():
        w = body.split()
        for k in range(12) if len(w) > 25 else ():
            v = list(w)
            for _ in range(k % 4):
                v[rnd.randrange(len(v))] = rnd.choice(WORDS)
            rows.append((len(rows), f"{own(rnd, rnd.randrange(80))} {' '.join(v)} {own(rnd, rnd.randrange(80))}", name))

    def held(text, body):
        import re
        cut = lambda t: re.findall(r"[^\W_]+", t.lower())
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = grams(cut(text)), grams(cut(body))
        return len(a & b) >= 0.8 * len(b)

    want = {(i, n) for i, t, n in rows if held(t, licenses.TEMPLATES[n])}
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    assert len(want) > 50 and len(want - got) <= 0.02 * len(want) and all(held(rows[i][1], licenses.TEMPLATES[n]) for i, n in got)


def test_pieces_beside_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 1, 2), (2, None, 1, 2), (3, "", 1, 2), (4, "word " * 50_000, 1, 2)], "doc_id long, text string, _encoded int, _decoded int")
    got = pieces.decode(pieces.encode(d)).collect()
    assert {r.doc_id: r.decoded for r in got} == {1: "a b", 2: "", 3: "", 4: "word " * 50_000} and all(r._encoded == 1 and r._decoded == 2 for r in got)


def test_very_long_texts_and_ties(spark):
    rnd = random.Random(11)
    long = own(rnd, 400_000)
    rows = [(1, long, "s"), (2, long + " end", "s"), (3, "one " * 1000, None), (4, "one " * 1000, None), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, None: None}
    kept = {r.doc_id: len(r.kept) for r in repeats.cut_repeats(d).collect()}
    assert kept[1] == 0 and kept[2] == 4 and kept[3] == kept[4] == 0
    assert sum(r.taken for r in mixing.mix(d).collect()) > 0


def test_mix_of_rows_without_or_with_repeated_ids(spark):
    """Targets are met, as for other rows, and reruns agree."""
    text = "word " * 100
    rows = [(None if i % 2 else 7, text, s) for s in "abc" for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    once, again = (sorted(map(tuple, mixing.mix(d).select("source", "doc_id", "target", "taken").collect()), key=repr) for _ in range(2))
    assert once == again and len(once) == 300
    for s, target in (("a", 5000), ("b", 10_000), ("c", 15_000)):
        mine = [r for r in once if r[0] == s]
        assert all(abs(r[2] - target) < 1e-6 for r in mine) and abs(sum(r[3] for r in mine) - target) <= 100
    assert mixing.mixed(d).count() == 300


def test_mix_draws_by_weight(spark):
    """Of two kinds of documents of the same size, the heavier one is drawn more often, in the mean as its chance says."""
    rows = [(i, "word " * 50, "a" if i % 4 else "b", 9.0 if i % 3 == 0 else 1.0) for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = [r for r in mixing.mix(d, weight="w").collect() if r.source == "b"]
    rate = got[0].target / got[0].source_size
    p, mean = rate - int(rate), (9 + 1 + 1) / 3
    share = {True: 9 / (9 + mean), False: 1 / (1 + mean)}
    all_ = (share[True] + 2 * share[False]) / 3
    for heavy in (True, False):
        mine = [r.copies - int(rate) for r in got if (r.doc_id % 3 == 0) == heavy]
        chance = p + min(p, 1 - p) * (share[heavy] - all_) / 2
        assert abs(sum(mine) / len(mine) - chance) < 4 * (chance * (1 - chance) / len(mine)) ** 0.5
