"""Stages of the pipeline against brute force."""

import random
import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "the ba na lo ré ti".split() for b in "and s on er ly zu".split()]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def first_of_classes(rows, size, percent):
    """Places of the rows that stay: the smallest (id, null last) of each class, and all without words."""
    sets, up = [shingles(r[1], size) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append((r[0] is None, r[0] or 0, i))
    return sorted(min(c)[2] for c in classes.values())


def test_near_duplicate_stage(spark):
    rnd = random.Random(3)
    texts, between = [None, "", "one", "one"], 0
    for k in range(12):
        w = rnd.choices(VOCABULARY, k=120)
        texts.append(" ".join(w))
        v = list(w)
        for at in ((60,), (30, 90))[k % 2]:  # one or two words inside: 0.92 and 0.84 of the five-word sets
            v[at] = "changed"
        texts.append(" ".join(v))
        v = w[:52]
        texts += [f"own{k} " + " ".join(v), f"own{k} " + " ".join([*v[:25], "changed", *v[26:]])]
        s, t = shingles(texts[-1], 5), shingles(texts[-2], 5)
        between += 80 <= 100 * len(s & t) / len(s | t) <= 85
    assert between == 12
    texts += ["a clean text of a document that has no id at all", "x y z x y z w v u", "x y z x y z w v u"]
    ids = [*range(len(texts) - 3), None, 7, 7]  # copies under one id, and that id elsewhere
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]
    kept = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted(((rows[i][0], rows[i][1]) for i in first_of_classes(rows, 5, 80)), key=repr)
