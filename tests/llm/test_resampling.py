"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from corpusq.llm import resampling

WORDS = [a + b for a in "the ba na lo re ti".split() for b in "and s on er ly zu".split()]


def expected(docs, target, n_max=1, buckets=10_000, seed=2024, least=20, percent=10):
    def features(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    total = lambda c: sum(c.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total(s) + buckets) / ((s[b] + 1) * (total(t) + buckets))))
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    take = percent * len(drawn) // 100
    for k, r in enumerate(drawn):
        r.append(k + 1 if k < take else None)
    return sorted(((r[0], r[2], r[3], r[4], r[5] if len(r) > 5 else None) for r in rows), key=repr)


def corpus():
    rnd = random.Random(3)
    own = lambda n: rnd.choice([" ", "-", "\n", "  "]).join(rnd.choice([w, w.upper(), w + "é", "7" + w]) for w in rnd.choices(WORDS, k=n))
    docs = [(i, own(rnd.randrange(60))) for i in range(500)]
    docs += [(None, own(30)), (None, docs[3][1]), (3, docs[3][1]), (600, None), (601, ""), (602, "... --- !"), (603, own(40_000)), (604, "É " * 25), (605, "Ünï x " * 25), (606, "KK İ " * 25)]
    return docs, [own(50) for _ in range(12)] + [None, ""]


def test_slices_hold_their_own_words(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 700)
    texts = [t for _, t in corpus()[0]]
    column, at = pa.array(["é", *texts]).slice(1), 0
    for part in resampling.slices(column):
        of, features, text_of, words = resampling.buckets_of(part, 1, 10_000)
        for k in range(len(part)):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[at + k] or "")
            want = [zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
            assert of[features[text_of == k]].tolist() == want and words[k] == len(want)
        at += len(part)
    assert at == len(texts)


@pytest.mark.parametrize("how", [{}, {"n_max": 3, "percent": 30}, {"n_max": 2, "buckets": 50, "seed": 7, "least_words": 0}])
def test_agrees_with_plain_python(spark, how):
    docs, target = corpus()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, n_words string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(d, t, **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    how = {"least": how.pop("least_words")} | how if "least_words" in how else how
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, target, **how)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    assert sorted(map(tuple, resampling.resample(one, none).collect())) == expected([(1, "a b " * 20), (2, None)], [])


def test_draws_follow_the_target(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choices(WORDS[:18] if i % 4 else WORDS[18:], k=40))) for i in range(800)]
    t = spark.createDataFrame([(" ".join(rnd.choices(WORDS[18:], k=400)),) for _ in range(20)], "text string")
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), t).where("rank is not null").collect()
    assert len(got) == 80 and sum(r.doc_id % 4 == 0 for r in got) >= 70
