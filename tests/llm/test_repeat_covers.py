"""Covers of a group's members, near ones in pairs and others in large intervals, against all maximal groups."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusq.llm import repeats


def arrays(rows):
    return np.array([g for g, _, _ in rows], np.int64), pa.array([r for _, r, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())


@pytest.mark.parametrize("near", [2, 5, 128])
def test_covers_are_the_widest_of_all_groups(monkeypatch, near):
    monkeypatch.setattr(repeats, "NEAR", near)
    rnd = random.Random(near)
    for _ in range(80):
        rows, want, length = [], [], rnd.randrange(4, 14)
        for g in range(rnd.randrange(1, 6)):
            letters = rnd.choice([b"ab", b"aab\0", b"abc"])
            own = sorted((g, bytes(rnd.choices(letters, k=rnd.randrange(2, 14))), bytes(rnd.choices(letters, k=rnd.randrange(0, 11)))) for _ in range(rnd.randrange(1, 40)))
            far = [[0, 0] for _ in own]
            for members, left, right in repeats.repeat_groups([r for _, r, _ in own], [x for _, _, x in own], length):
                for m in members:
                    far[m] = [max(far[m][0], left), max(far[m][1], right)]
            rows, want = rows + own, want + far
        assert np.transpose(repeats.covers(*arrays(rows), length)).tolist() == want


def test_a_large_group_is_compared_by_rows_of_words(monkeypatch):
    """Many contexts of one anchor that share most of what they are: before, each interval was sorted by comparing strings
    one by one, with a call of shared() for each two neighbours."""
    calls, of = [], repeats.Strings.shared
    monkeypatch.setattr(repeats.Strings, "shared", lambda self, a, b: calls.append(len(a)) or of(self, a, b))
    monkeypatch.setattr(repeats, "shared", None)
    rnd = random.Random(7)
    tail = bytes(rnd.choices(b"abcdefgh", k=180))
    rows = sorted((0, tail + bytes(rnd.choices(b"abcdefgh", k=20)), tail[: rnd.randrange(60, 130)][::-1]) for _ in range(3000))
    left, right = repeats.covers(*arrays(rows), 200)
    assert (right >= 180).all() and len(calls) < 3000
