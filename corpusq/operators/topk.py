"""Queries against a corpus, block by block: every task keeps the k best chunks of each of its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.codes import sliced

#: Bytes of the query side that are sent to every task; beyond them both sides meet in pairs of blocks.
BROADCAST = 16 << 20
#: Rows of a block of queries and of chunks, scores computed at once, and chunks with one upper bound.
QUERIES, CHUNKS, SCORES, BOUND = 1024, 32_768, 1 << 22, 256
#: Words of chunks that are coded at once, and scored chunks that are sorted into the lists at once.
WORDS, FOUND = 1 << 20, 1 << 18


class Best:
    """The k best (score, chunk) of each query so far: higher scores first, then smaller chunk ids."""

    def __init__(self, queries: pa.Array, kind: pa.DataType, k: int) -> None:
        self.queries, self.k = queries, k
        self.least = np.full(len(queries), -np.inf)  # a score below that is in no list
        self.rows = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], kind)})

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Only the lists of the queries in `q` are sorted anew."""
        if not len(q):
            return
        touched = np.zeros(len(self.queries), bool)
        touched[q] = True
        mine = pa.array(touched[self.rows["q"].to_numpy()])
        rows = pa.concat_tables([self.rows.filter(mine), pa.table({"q": pa.array(q), "score": pa.array(score), "id": ids})])
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
        own = rows["q"].to_numpy()
        place = np.arange(len(own)) - np.searchsorted(own, own)
        self.rows = pa.concat_tables([self.rows.filter(pc.invert(mine)), rows.filter(pa.array(place < self.k))]).combine_chunks()
        full = place == self.k - 1
        self.least[own[full]] = rows["score"].to_numpy()[full]

    def table(self) -> pa.Table:
        return pa.table({"query_id": self.queries.take(self.rows["q"].combine_chunks()), "chunk_id": self.rows["id"], "score": self.rows["score"]})


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of the same length as rows; missing numbers are NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without length are NaN, which is no score."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


class Dense:
    """Cosines with 6 places of all queries (query_id, v) and the chunks (chunk_id, v) that are added."""

    def __init__(self, queries: pa.Table, kind: pa.DataType, k: int, threshold: float | None = None, own: bool = True) -> None:
        self.ids, self.unit = queries["query_id"].combine_chunks(), unit(matrix(queries["v"].combine_chunks()))
        self.best, self.threshold, self.own = Best(self.ids, kind, k), -np.inf if threshold is None else threshold, own

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            part = ids.slice(a, step)
            s = self.unit @ unit(matrix(vectors.slice(a, step))).T
            s *= 1e6
            s += 0.5
            np.floor(s, out=s)
            s /= 1e6
            s[np.isnan(s)] = -np.inf
            if not self.own:
                codes = np.unique(np.concatenate([self.ids.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
                s[codes[: len(self.ids), None] == codes[None, len(self.ids) :]] = -np.inf
            k = self.best.k
            enough = np.maximum(self.best.least, self.threshold)
            if s.shape[1] > k:
                enough = np.maximum(enough, np.partition(s, -k, axis=1)[:, -k])
            q, c = np.nonzero((s >= enough[:, None]) & (s > -np.inf))
            self.best.add(q, s[q, c], part.take(pa.array(c)))


class Sparse:
    """Dot products of the word counts of queries (query_id, words) and of the chunks (chunk_id, words) that are added.

    Chunks stand in order of impact, the sum of their weights, in blocks of BOUND with the highest weight of each word.
    A block is skipped for a query if these weights, all together, stay below the query's k-th score so far: no chunk of
    it can be among the k best, so the result is exact. With `once` every word counts once.
    """

    def __init__(self, queries: pa.Table, kind: pa.DataType, k: int, once: bool = False) -> None:
        ids, words = queries["query_id"].combine_chunks(), queries["words"].combine_chunks()
        coded = pc.dictionary_encode(words.flatten())
        self.vocabulary, self.once, self.best = coded.dictionary, once, Best(ids, kind, k)
        self.blocks = self.skipped = 0
        own = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        q, term, weight = self.counted(own, coded.indices.to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(q, np.arange(len(ids) + 1))
        self.terms = [(term[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:])]

    def counted(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, how often) by row and term."""
        pair, n = np.unique(row.astype(np.int64) * max(1, len(self.vocabulary)) + term, return_counts=True)
        return pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary)), np.ones(len(n)) if self.once else n.astype(float)

    def add(self, ids: pa.Array, words: pa.Array) -> None:
        """In slices of about WORDS words, so that memory follows these and not the batch."""
        for i, j in sliced(pc.list_value_length(words), WORDS):
            self.add_slice(ids.slice(i, j - i), words.slice(i, j - i))

    def add_slice(self, ids: pa.Array, words: pa.Array) -> None:
        code = pc.index_in(words.flatten(), value_set=self.vocabulary)
        own = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        known = code.is_valid().to_numpy(zero_copy_only=False)
        doc, term, weight = self.counted(own[known], pc.drop_null(code).to_numpy())
        order = np.argsort(-np.bincount(doc, weight, len(ids)), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        sort = np.lexsort((term, place[doc] // BOUND))
        place, term, weight = place[doc][sort], term[sort], weight[sort]
        n = -(-len(ids) // BOUND)
        cuts = np.searchsorted(place // BOUND, np.arange(n + 1))
        highest = np.zeros((len(self.vocabulary) + 1, n))
        np.maximum.at(highest, (term, place // BOUND), weight)
        bound = np.array([w @ highest[t] if len(t) else np.zeros(n) for t, w in self.terms])
        for b in range(n if len(bound) else 0):
            open_ = np.flatnonzero((bound[:, b] >= self.best.least) & (bound[:, b] > 0))
            self.blocks, self.skipped = self.blocks + len(bound), self.skipped + len(bound) - len(open_)
            if not len(open_):
                continue
            here, row = np.unique(term[cuts[b] : cuts[b + 1]], return_inverse=True)
            weights = np.zeros((len(here) + 1, BOUND))
            weights[row, place[cuts[b] : cuts[b + 1]] - b * BOUND] = weight[cuts[b] : cuts[b + 1]]
            at = np.full(len(self.vocabulary) + 1, len(here))
            at[here] = np.arange(len(here))
            found: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i, q in enumerate(open_.tolist()):
                t, w = self.terms[q]
                s = w @ weights[at[t]]
                c = np.flatnonzero((s > 0) & (s >= self.best.least[q]))
                if len(c) > self.best.k:  # no more than k of a block, and ties
                    c = c[s[c] >= np.partition(s[c], -self.best.k)[-self.best.k]]
                found.append((np.full(len(c), q), s[c], order[b * BOUND + c]))
                held += len(c)
                if held >= FOUND or i == len(open_) - 1:
                    q_, s_, c_ = (np.concatenate(x) for x in zip(*found))
                    self.best.add(q_, s_, ids.take(pa.array(c_)))
                    found, held = [], 0


def grouped(q: DataFrame, c: DataFrame, keys: list[str], scorer: Callable[[pa.Table], object], kind: str) -> DataFrame:
    """Queries and chunks that agree in the keys meet in a task; both sides of a group are of a bounded size."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = scorer(left)
        if left.num_rows and right.num_rows:
            for b in right.to_batches():
                s.add(b.column("chunk_id"), b.column(right.num_columns - 1))
        return s.best.table()

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, kind)


def best_in_blocks(queries: DataFrame, corpus: DataFrame, scorer: Callable[[pa.Table], object], size: int) -> DataFrame:
    """(query_id, x) x (chunk_id, x) -> query_id, chunk_id, score: of each task the k best of each of its queries.

    Queries of no more than BROADCAST bytes, `size` in all, are sent to all tasks, which read the corpus where it is: so
    many rows are shuffled as there are tasks, queries and places. Beyond that both sides are dealt into blocks of
    about QUERIES and CHUNKS rows, and each pair of blocks meets in a group of its own.
    """
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"
    if size <= BROADCAST:
        shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())  # of the size checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = scorer(shared.value)
            for b in batches:
                s.add(b.column(0), b.column(1))
            yield from s.best.table().combine_chunks().to_batches()

        return corpus.mapInArrow(run, kind)
    nq, nc = (max(1, -(-d.count() // n)) for d, n in ((queries, QUERIES), (corpus, CHUNKS)))
    dealt = lambda d, key, n, mine, other, m: d.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    q, c = dealt(queries, "query_id", nq, "_qb", "_cb", nc), dealt(corpus, "chunk_id", nc, "_cb", "_qb", nq)
    keys = ["_qb", "_cb"]
    return grouped(q.select(*keys, *queries.columns), c.select(*keys, *corpus.columns), keys, scorer, kind)
