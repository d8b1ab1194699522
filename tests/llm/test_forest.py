"""Near-duplicates of the LSH forest against all pairs."""

import random
import re

import pytest

from corpusq.llm import forest

WORDS = [a + b + c for a in "the ba na lo re ti".split() for b in "and s on er ly zu".split() for c in "a e i o".split()]


def brute(rows, size=2, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(i, ids.get(root(k), i))
    first = {s: ids[root(k)] for k, s in enumerate(sets) if s and rows[k][0] is not None}
    found = [ids[root(k)] if i is not None else first.get(sets[k]) for k, (i, _) in enumerate(rows)]
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, found)), key=repr)


def corpus(rnd, copies):
    own = lambda n: rnd.choices(WORDS, k=n)
    texts = [own(rnd.randrange(40, 200)) for _ in range(60)]
    for t in list(texts[:20]):
        for changes in (1, 2, 4, 8, 16):
            v = list(t)
            for _ in range(changes):
                v[rnd.randrange(len(v))] = rnd.choice(WORDS)
            texts.append(v)
    base = own(300)
    for _ in range(copies):  # one large group of near copies, no two alike
        v = list(base)
        for _ in range(6):
            v[rnd.randrange(len(v))] = rnd.choice(WORDS)
        texts.append(v)
    passage = own(120)
    texts += [passage + own(50) for _ in range(copies)]  # a passage that many share, too little to link
    chain = own(100)
    for k in range(30):  # each links with the next only
        chain = chain[7:] + own(7)
        texts.append(list(chain))
    rows = [(i, rnd.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(9000, rows[0][1].upper()), (None, rows[1][1]), (None, rows[1][1]), (9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "two"), (9007, "É one"), (9008, "é one"), (rows[2][0], rows[2][1])]
    return rows


@pytest.mark.parametrize("region", [2000, 40])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, region):
    monkeypatch.setattr(forest, "REGION", region)
    rows = corpus(random.Random(21), 150)
    d = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = forest.near_duplicates(d)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute(rows) and sum(not r[3] for r in got) > 150


def test_recall_at_the_limit(spark):
    """Pairs at 0.80 to 0.85, alone in their region: their one link must be found."""
    rnd, rows = random.Random(22), []
    while len(rows) < 600:
        a = rnd.choices(WORDS, k=200)
        b = list(a)
        for k in rnd.sample(range(1, 199, 4), rnd.choice([9, 10, 11])):
            b[k] = rnd.choice(WORDS)
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    want = brute(rows)
    got = sorted(map(tuple, forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == want and sum(not r[3] for r in want) > 100


def test_very_long_texts_and_empty_table(spark):
    rnd = random.Random(23)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
