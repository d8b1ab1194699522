"""Terms counted in rows, where rows share keys too."""

import collections
import math
import re

import pytest

from corpusq.operators import vectors

ROWS = [(1, "Ab ab c. Дом дом, c"), (2, None), (3, ""), (4, "c c c d"), (4, "c d e"), (4, "x"), (None, "c x"), (None, "x"), (5, "e"), (6, "ab c")]


@pytest.mark.parametrize("at_once", [2, 1000])
@pytest.mark.parametrize("rows", [ROWS, [r for r in ROWS if r[0] not in (None, 4)]])
def test_counts(spark, monkeypatch, rows, at_once):
    monkeypatch.setattr(vectors, "WORDS", at_once)
    d = spark.createDataFrame(rows, "id long, text string")
    terms = [(k, re.findall(r"\w+", (t or "").lower())) for k, t in rows]
    want = {}
    for k, w in terms:
        want.setdefault(k, collections.Counter()).update(int(vectors.term_indices([x])[0]) for x in w)
    got = {r.id: r for r in vectors.encode_sparse(d, "id", "text").collect()}
    assert {k: (r.indices, r["values"]) for k, r in got.items()} == {k: (sorted(c), [c[i] for i in sorted(c)]) if c else (None, None) for k, c in want.items()}

    tf, mean = collections.Counter(), sum(len(w) for _, w in terms) / len(terms)
    for k, w in terms:
        tf.update((k, len(w), x) for x in w)
    df = collections.Counter(x for _, _, x in tf)
    want = sorted((k or 0, x, round(math.log(1 + (len(rows) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)), 9)) for (k, length, x), n in tf.items())
    for most in (0, 1000):
        monkeypatch.setattr(vectors, "TERMS", most)
        assert sorted((r.id or 0, r.term, round(r.weight, 9)) for r in vectors.bm25_weights(d, "id", "text").collect()) == want


def test_terms_are_not_shuffled_one_by_one(spark):
    d = spark.createDataFrame(ROWS[:3], "id long, text string")
    for made in (vectors.encode_sparse(d, "id", "text"), vectors.bm25_weights(d, "id", "text")):
        assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
