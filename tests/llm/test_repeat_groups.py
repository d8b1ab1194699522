"""Repeat groups with all occurrences, and large groups split by what they share."""

import collections
import itertools
import random

import pytest

from corpusq.llm import repeats


def test_groups_are_maximal_with_all_occurrences():
    rnd = random.Random(4)
    for _ in range(60):
        made = sorted((bytes(rnd.choices(b"ab", k=rnd.randrange(2, 9))), bytes(rnd.choices(b"ab", k=rnd.randrange(0, 7)))) for _ in range(12))
        rights, lefts = [r for r, _ in made], [x for _, x in made]
        got = {(frozenset(m), left, right) for m, left, right in repeats.repeat_groups(rights, lefts, 5)}
        want = set()
        for a, b in itertools.combinations(range(12), 2):
            right, left = repeats.shared(rights[a], rights[b]), repeats.shared(lefts[a], lefts[b])
            members = [k for k in range(12) if rights[k][:right] == rights[a][:right] and lefts[k][:left] == lefts[a][:left]]
            exact = min(repeats.shared(rights[x], rights[y]) for x, y in itertools.combinations(members, 2)), min(repeats.shared(lefts[x], lefts[y]) for x, y in itertools.combinations(members, 2))
            if left + right >= 5 and exact == (right, left):
                want.add((frozenset(members), left, right))
        assert {g for g in want} <= {(m, left, right) for m, left, right in got}
        for members, left, right in got:  # whoever shares as much is a member
            assert members == {k for k in range(12) if rights[k][:right] == rights[min(members)][:right] and lefts[k][:left] == lefts[min(members)][:left] and len(rights[k]) >= right and len(lefts[k]) >= left}


@pytest.mark.parametrize("group", [2, 40])
def test_hot_grams_and_runs_of_one_byte(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HOT", 20)
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    short, shared = word(150), word(260)
    rows = [(i, word(rnd.randrange(150, 400)) + short + word(rnd.choice([20, 200])), 0) for i in range(60)]
    tails = [word(90) for _ in range(4)]
    rows += [(100 + i, word(150) + tails[i % 4] + short + tails[i // 4 % 4] + word(100), 0) for i in range(32)]
    rows += [(200 + i, word(30) + shared + word(i), 0) for i in range(10)] + [(300, "a" * 3000, 0), (301, None, 0), (302, word(5000), 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(3)
    data = {r[0]: (r[1] or "").encode() for r in rows}
    count = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    got = {r.doc_id: bytes(r.kept) for r in repeats.cut_repeats(d).collect()}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert got[i] == bytes(x for x, g in zip(b, gone) if not g), i
    assert sum(len(b) for b in data.values()) - sum(map(len, got.values())) > 5000
