"""Periodic runs of words inside a text, found as maximal pairs."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many periods, and at least so many words.
PERIODS, LEAST = 4, 6
#: Words of short texts that are sorted together, and their bytes; a longer text is sorted alone.
SLICE, SLICE_BYTES = 1 << 18, 4 << 20


def repeated_grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n ids begin that stand more than once. Ids of different texts differ, so texts keep apart."""
    if len(ids) < n + 1:
        return np.zeros(0, np.int64)
    gram = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):  # wraps; equal grams are told apart from clashes when they are sorted
        gram = (gram ^ ids[j : len(ids) - n + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    return np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])


def suffix_order(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order of what follows them in their text, and for each power of two the ranks by so many ids.

    `end` is where each position's text ends. Ranks double in length; only what is not yet told apart is sorted again.
    """
    order = np.argsort(ids, kind="stable").astype(np.int32)
    rank, ranks, step = np.empty(len(ids), np.int32), [], 1
    new = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while True:
        ranks.append(rank)
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, ranks
        at = order[open_]
        next_ = at + step
        second = np.where(next_ < end[at], rank[np.minimum(next_, len(ids) - 1)], -1)
        sort = np.lexsort((second, rank[at]))
        at, second = at[sort], second[sort]
        first = rank[at]
        differs = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        order[open_], new[open_], rank = at, differs, rank.copy()
        rank[at] = open_[np.flatnonzero(differs)[np.cumsum(differs) - 1]]
        step *= 2


def shared(a: np.ndarray, b: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many ids follow alike at a and at b."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + n, len(end) - 1), np.minimum(b + n, len(end) - 1)
        n += np.where((a + n < end[a]) & (b + n < end[b]) & (ranks[j][x] == ranks[j][y]), 1 << j, 0)
    return n


def near_enough(at: np.ndarray, common: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and what each shares with the one before, without those that are in no pair: a suffix whose
    longest match is no longer than `ratio` times the way to the nearest place that starts alike."""
    most = np.maximum(common, np.append(common[1:], 0))
    group = np.cumsum(common < least)
    by_place = np.lexsort((at, group))
    gap = np.where(group[by_place][1:] == group[by_place][:-1], np.diff(at[by_place]), np.iinfo(np.int32).max)
    nearest = np.empty(len(at), np.int64)
    nearest[by_place] = np.minimum(np.append(gap, np.iinfo(np.int32).max), np.concatenate([[np.iinfo(np.int32).max], gap]))
    keep = np.flatnonzero((most >= least) & (ratio * nearest <= most))
    if not len(keep):
        return at[:0], common[:0]
    # what neighbours share after others between them are gone is the least on the way
    starts = np.concatenate([[0], keep[:-1] + 1])
    return at[keep], np.minimum.reduceat(common[: keep[-1] + 1], starts)


def maximal_pairs(at: list[int], common: list[int], left: Callable[[int], int], least: int, ratio: int) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, shared) of maximal pairs that share at least `least` ids and `ratio` times their distance.

    `at` are suffixes in order, `common` what each shares with the one before. The tree of their common prefixes is
    built bottom-up with a stack: when two parts of an interval meet, their places differ in what follows, and they
    form a maximal pair if what stands before them (`left`) differs too. An interval keeps its places in order, with
    the classes of what stands before them in one list: places in reach of each other stand in one periodic stretch,
    all but whose first are of one class, so that of the places to the left only the farthest in reach can be of
    another class, and of those to the right either all are or none is. Each look costs one bisection and what it finds.
    """
    stack: list[tuple[list[int], int]] = []  # places of an open interval, and what it shares with the one below

    def meet(h: int) -> Iterator[tuple[int, int, int]]:
        b, below = stack.pop()
        a, under = stack.pop()
        small, large = (a, b) if len(a) < len(b) else (b, a)
        reach = h // ratio
        for p in small if reach else ():
            k = bisect_left(large, p - reach)
            if k < len(large) and large[k] < p and left(large[k]) != left(p):
                yield large[k], p - large[k], h
            k = bisect_left(large, p, k)
            while k < len(large) and large[k] <= p + reach and left(large[k]) != left(p):
                yield p, large[k] - p, h
                k += 1
        for p in small:
            if large[-1] < p:
                large.append(p)
            else:
                insort(large, p)
        stack.append((large, under))

    for p, h in zip(at, common):
        if h < least:
            while len(stack) > 1:
                yield from meet(stack[-1][1])
            stack = [([p], 0)]
            continue
        while len(stack) > 1 and stack[-1][1] > h:
            yield from meet(stack[-1][1])
        stack.append(([p], h))
    while len(stack) > 1:
        yield from meet(stack[-1][1])


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of ids, by start and period. Equal words of a text have equal
    ids from 0 on.

    Maximal pairs at distance d that share n ids are stretches of d + n with period d that no neighbour extends. With
    at least PERIODS * d and LEAST ids they are the runs, also at multiples of the smallest period, which is kept. So
    a pair shares at least `least` ids; only places whose `least` ids stand twice in their text are sorted.
    """
    ratio = PERIODS - 1
    least = min(max(LEAST - d, ratio * d) for d in range(1, LEAST + 1))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    offset = np.cumsum([0, *(max(t, default=-1) + 1 for t in texts)])
    ids = np.fromiter((x for t in texts for x in t), np.int64, int(sizes.sum())) + np.repeat(offset[:-1], sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hit = np.unique(np.searchsorted(ends, repeated_grams(ids, least), side="right"))
    if not len(hit):
        return out
    inside = np.isin(np.repeat(np.arange(len(texts)), sizes), hit)
    ids, own = ids[inside], np.repeat(hit, sizes[hit])
    stop = np.cumsum(sizes[hit])
    first = stop - sizes[hit]
    end = np.repeat(stop, sizes[hit])
    order, ranks = suffix_order(ids, end)
    common = np.concatenate([[0], shared(order[:-1], order[1:], end, ranks)])
    del ranks
    at, common = near_enough(order, common, least, ratio)
    begins, of_text = dict(zip(hit.tolist(), first.tolist())), own
    starts = set(first.tolist())
    left = lambda p: -1 - p if p in starts else int(ids[p - 1])
    found: dict[tuple[int, int, int], int] = {}
    for p, d, n in maximal_pairs(at.tolist(), common.tolist(), left, least, ratio):
        if n >= max(LEAST - d, ratio * d):
            key = int(of_text[p]), p, d + n
            found[key] = min(d, found.get(key, d))
    for (k, p, n), d in sorted(found.items()):
        out[k].append((p - begins[k], n, d))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period) and collapsed (the words left once
    each run is cut to its first period, joined by one space) of every row of `docs`.

    A run is a stretch of consecutive words with smallest period q, at least PERIODS * q and LEAST long, that no
    neighbouring word extends. Words are runs of characters other than ASCII white space, taken as they are. `edit`
    may turn a row's id and words into other words before the search.

    Each text is searched in the task that reads it: nothing is shuffled, and memory follows the longest text, at
    about 200 bytes a word, 100 more where a phrase goes on for the whole of it.

    Null, empty or wordless text: no words, no runs, an empty text. Rows are kept as they are, repeated ones and null
    ids included. Other columns, whatever their names, are not read. Empty table: empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
        numbered = []
        for words in texts:
            number: dict[bytes, int] = {}
            numbered.append([number.setdefault(w, len(number)) for w in words])
        for i, words, runs in zip(ids, texts, runs_of(numbered)):
            if runs:
                gone = dropped(len(words), runs)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            yield i, len(gone) if runs else len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(words).decode()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size, bytes_ = [], [], 0, 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                ids.append(i)
                texts.append(edit(i, words) if edit else words)
                size, bytes_ = size + len(texts[-1]), bytes_ + (len(t.as_buffer()) if t.is_valid else 0)
                if size >= SLICE or bytes_ >= SLICE_BYTES or k == b.num_rows - 1:
                    rows = list(zip(*found(ids, texts)))
                    yield pa.record_batch([pa.array(rows[0], b.column(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], run), pa.array(rows[3], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                    ids, texts, size, bytes_ = [], [], 0, 0

    out = docs.select(F.col(doc_id), F.col(text)).mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.toDF(doc_id, "n_words", "runs", "collapsed")


def run_summary(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The number of runs, the strongest one and digests of the runs and the collapsed text, of what `word_runs` gives.

    Of all runs the one of the greatest length / period is given, exactly: two quotients are compared by their cross
    products. Ties go to the smallest start, then period."""
    r = F.col("runs")
    lines = F.transform(r, lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))))
    digest = F.sha2(F.concat(F.concat_ws("\n", lines), F.when(F.size(r) > 0, "\n").otherwise("")), 256)
    zero = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, x: a.isNull() | (x.length * a.period > a.length * x.period)  # noqa: E731  in order, so ties keep the first
    best = F.aggregate(r, zero, lambda a, x: F.when(better(a, x), x).otherwise(a))
    d = found.withColumn("best", best)
    return d.select(
        doc_id, F.size(r).cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
