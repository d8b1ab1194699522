"""Texts of more than one piece: each anchor once, and the same bytes cut as by brute force."""

import collections
import random

import numpy as np

from corpusq.llm import repeats


def test_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    again = letters(700)
    texts = [letters(20_000), letters(1_300) + again + letters(5_000), letters(3_100) + again, letters(900)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    anchors = lambda: [(t, a, h, c) for x in repeats.anchors_of(data, ends, 200, 64) for t, a, h, c in zip(*(x[k].tolist() for k in (0, 1, 4, 5)))]
    want = sorted(anchors())
    monkeypatch.setattr(repeats, "PIECE", 1_000)
    assert sorted(anchors()) == want and len(set(want)) == len(want)
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def small(batches):  # in the workers, which import the module anew
        repeats.PIECE = 1_000
        yield from batches

    for r in repeats.cut_repeats(d.mapInArrow(small, d.schema)).collect():
        t = texts[r.doc_id]
        gone = set().union(*(range(k, k + 200) for k in range(len(t) - 199) if count[t[k : k + 200]] > 1))
        assert bytes(r.kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone)
