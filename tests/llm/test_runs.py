"""Periodic runs against a search of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from corpusq.llm import queries, runs

WORD = r"[^\x20\x09-\x0D]+"


def brute(words):
    """All (start, length, period): stretches of period q that no neighbour extends, q their smallest period."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    kind = rnd.randrange(6)
    if kind == 0:
        return rnd.choices("ab", k=rnd.randrange(60))
    if kind == 1:
        return rnd.choices("abcd", k=rnd.randrange(200))
    out = []
    for _ in range(rnd.randrange(1, 6)):
        unit = rnd.choices("abcxyz"[: rnd.randrange(1, 7)], k=rnd.randrange(1, 9))
        out += rnd.choices("uvw", k=rnd.randrange(4)) + (unit * rnd.randrange(1, 9))[: rnd.randrange(1, 60)]
    return out


def test_runs_are_those_of_a_search_of_all_stretches():
    rnd = random.Random(5)
    texts = [random_words(rnd) for _ in range(3000)] + [[], ["a"], ["a"] * 6, ["a"] * 5, ["a", "b"] * 4, list("aab" * 40), ["one"] * 900]
    numbered = [[sorted(set(t)).index(w) for w in t] for t in texts]
    for k in range(0, len(texts), 500):
        assert runs.runs_of(numbered[k : k + 500]) == [brute(t) for t in texts[k : k + 500]]


def test_many_runs_in_one_text_stay_fast():
    words = [w for k in range(20_000) for w in (f"x{k}", *["a"] * 9)]
    number = {}
    got = runs.runs_of([[number.setdefault(w, len(number)) for w in words]])[0]
    assert got == [(10 * k + 1, 9, 1) for k in range(20_000)]


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = edited(doc_id, re.findall(WORD, text or "")) if doc_id is not None else re.findall(WORD, text or "")
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_over_all_documents(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(random_words(rnd)) + rnd.choice(["", "\n", "\x0b x", " é ü"])) for i in range(400)]
    rows += [(None, "a " * 9), (None, None), (7, rows[7][1]), (500, None), (501, ""), (502, " \t\n"), (503, "\x1c a \x1c " * 5), (504, "w " * 1_500), (505, "   " * 9)]
    d = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert queries.op11_periodic_runs(spark, str(tmp_path)).where("n_runs > 0").count() > 100


def test_empty_table(spark):
    assert runs.word_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
