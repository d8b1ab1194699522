"""Fingerprints against exact generalised Jaccard, and what is next of each row."""

import collections
import hashlib
import random
import re

import pytest

from corpusq.llm import fingerprints

VOCABULARY = [a + b for a in "the ba na lo ré ti".split() for b in "and s on er ly zu".split()]


def terms(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def corpus():
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        w = rnd.choices(VOCABULARY, k=rnd.choice([3, 40, 200]))
        rows.append((2 * i, " ".join(w)))
        v = list(w) * rnd.choice([1, 1, 3])  # repeated terms: weights above 1
        v[rnd.randrange(len(v))] = "other"
        rows.append((2 * i + 1, " ".join(v)))
    return [*rows, (200, None), (201, ""), (202, "long " + " ".join(rnd.choices(VOCABULARY, k=30000))), (None, "no id at all here"), (None, None), (7, rows[3][1]), (7, rows[3][1])]


@pytest.mark.parametrize("stretch", [1000, 7])
def test_likeness_is_generalised_jaccard(spark, monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "ROWS", stretch)
    rows = [(i, t, "a", 0) for i, t in corpus()]
    d = spark.createDataFrame(rows, "doc_id long, text string, _text string, _seq int").repartition(3)
    got = fingerprints.fingerprints(d, samples=512).collect()
    assert len(got) == len(rows)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    ids = [r for r in rows if r[0] is not None and r[0] not in (7,)]
    by_id = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    order, off = sorted(by_id), []
    for r in got:
        if r.doc_id is None or r.doc_id in (7, 202):
            continue
        t, after = by_id[r.doc_id], by_id[order[order.index(r.doc_id) + 1]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            j = jaccard(t, other)
            off.append(abs(near - j) / max((j * (1 - j) / 512) ** 0.5, 1e-9 if j in (0, 1) else 1e-3))
            assert abs(near - j) <= 4.5 * (j * (1 - j) / 512) ** 0.5 + 1e-12
    assert len(ids) > 100 and sum(x <= 3 for x in off) >= 0.97 * len(off)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r.n_chars, r.doc_id if r.doc_id is not None else "none"].add(r.fingerprint)
    assert all(len(s) == 1 for k, s in prints.items() if k[1] == 7)


def test_one_row_is_its_own_next(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprints.fingerprints(d).collect()[0]
    assert r.near_next == 1.0 and len(r.fingerprint) == 512
