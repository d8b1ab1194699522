"""N-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, groups_of, mixed_bits, utf8, written
from .graph import components

SIZE, PERCENT = 3, 90
#: Counters by which shingles are ordered; the table has this size whatever the input.
BINS = 1 << 18
#: Sets, and bytes of sets, that one task compares; longer lists are split into pairs of blocks.
LIST, BLOCK = 4000, 8 << 20
#: Bytes of text hashed at once.
SLICE = 1 << 20
#: Bits by which texts of no family are told before they are shuffled.
FILTER = 1 << 23
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word begins, its hash) of texts that lie one after the other. Bytes are taken in slices of about
    SLICE that end between words, so what is held at once does not grow with the batch or with a long text."""
    begins, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        while to < len(data) and not SPACES[data[to]]:
            step = np.flatnonzero(SPACES[data[to : to + SLICE]])
            to = to + int(step[0]) if len(step) else min(to + SLICE, len(data))
        piece = LOWER[data[at:to]]
        word = ~SPACES[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[ends[np.searchsorted(ends, at) : np.searchsorted(ends, to, side="right")] - at] = True
        begin = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        stop = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        hashes.append(Rolling(piece).of(begin, stop) ^ mixed_bits((stop - begin).astype(np.uint64)))
        begins.append(begin + at)
        at = to
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; of fewer words, one of them all."""
    data, ends = utf8(texts)
    begin, h = word_hashes(data, ends)
    bounds = np.searchsorted(begin, ends).tolist()
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            n = b - a - size + 1
            grams = np.zeros(n, np.uint64)
            for j in range(size):
                grams = mixed_bits(grams + h[a + j : a + j + n])
            out.append(np.unique(grams))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def bin_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle in each of BINS bins, over all documents: BINS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for s in shingle_sets(b.column(0), size):
                np.add.at(total, (s & np.uint64(BINS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    sums = docs.select("_text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BINS, np.int64)
    counts[sums["bin"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return counts


def least_shared(a: int, b: int, percent: int) -> int:
    """Shingles that sets of these sizes share at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's shingles over a power of two of bits, about half as many as shingles. Where two bitmaps
    differ the sets differ, so the bits that differ are no more than the shingles that do."""
    bits = 64
    while bits * 2 < len(s):
        bits *= 2
    at = (mixed_bits(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """_id, _text -> id, set (128-bit hash as two longs), n, bitmap, and the prefix: the rarest shingles, one of
    which any linked set shares."""
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second, ns, maps, heads = [], [], [], [], []
            for s in shingle_sets(b.column(1), size):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                ns.append(len(s))
                maps.append(bitmap(s))
                rare = np.lexsort((s, order.value[(s & np.uint64(BINS - 1)).astype(np.int64)]))
                heads.append(s[rare[: len(s) - (-(-percent * len(s) // 100)) + 1]].view(np.int64) if len(s) else s.view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(ns, pa.int64()), pa.array(maps, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], names=["id", "s1", "s2", "n", "map", "head"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(run, f"id {kind}, s1 long, s2 long, n long, map binary, head array<long>")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def blocked(df: DataFrame, blocks: Column, seed: Column) -> DataFrame:
    """Copies of each row for every pair of blocks that its own is in: _i, _j, and _own, its block."""
    own = F.pmod(F.xxhash64(seed), blocks).cast("int")
    d = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return d.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")


def candidate_links(ns: list[int], at: list[int], maps: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """A forest over an index list: sets are joined that may link by size, place in the list and bitmap.

    The list is in order of size and, within a size, of place: blocks of equal size. For a set, blocks of too small a
    size are skipped whole, and of each other block what comes after the last place from which enough shingles
    can follow is skipped. Of the rest, sets of a class that the set has joined are skipped.
    """
    bits = [int.from_bytes(m, "little") for m in maps]
    width = [len(m) * 8 for m in maps]
    forest = Forest(len(ns))
    blocks: list[tuple[int, list[int], list[int]]] = []  # size, places and sets in order of place
    low = 0

    def near(x: int, y: int, need: int) -> bool:
        a, b, w, v = bits[x], bits[y], width[x], width[y]
        while w > v:
            w //= 2
            a = (a >> w) ^ (a & ((1 << w) - 1))
        while v > w:
            v //= 2
            b = (b >> v) ^ (b & ((1 << v) - 1))
        return (a ^ b).bit_count() <= ns[x] + ns[y] - 2 * need

    for x in range(len(ns)):
        n = ns[x]
        while low < len(blocks) and 100 * blocks[low][0] < percent * n:
            low += 1
        mine = x
        for k in range(len(blocks) - 1, low - 1, -1):
            size, places, sets = blocks[k]
            need = least_shared(n, size, percent)
            if n - at[x] < need:
                continue
            for y in sets[: bisect_right(places, size - need)]:
                top = forest.root(y)
                if top != mine and near(x, y, need):
                    forest.join(x, y)
                    mine = forest.root(x)
                    yield x, y
        if not blocks or blocks[-1][0] != n:
            blocks.append((n, [], []))
        blocks[-1][1].append(at[x])
        blocks[-1][2].append(x)


class Shared:
    """How many shingles a set shares with others, of sets that lie one after the other as numbers of shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.ends = np.cumsum([0, *map(len, sets)])
        known, self.items = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
        self.items = self.items.astype(np.int32)
        self.mine = np.zeros(len(known), bool)

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        """With each of `others`, none of which is empty."""
        own = self.items[self.ends[x] : self.ends[x + 1]]
        self.mine[own] = True
        out, at = np.zeros(len(others), np.int64), 0
        while at < len(others):  # about SLICE shingles at once
            n = self.ends[others[at:] + 1] - self.ends[others[at:]]
            n = n[: max(1, int(np.searchsorted(np.cumsum(n), SLICE)))]
            starts = np.cumsum(n) - n
            where = np.repeat(self.ends[others[at : at + len(n)]] - starts, n) + np.arange(starts[-1] + n[-1])
            out[at : at + len(n)] = np.add.reduceat(self.mine[self.items[where]], starts, dtype=np.int64)
            at += len(n)
        self.mine[own] = False
        return out


def exact_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A forest of exact links over sets in order of size, none of which is empty.

    Each set is compared with the first of every class; from how far it and the others are from there follow
    bounds for how far it is from the others (shingles not shared are a metric): some links are certain, most
    pairs are out of question, and only the rest is compared, the closest by bound first. Sets of a class that the
    set has joined are skipped: with a leader's class all sets that joined it, without a look at each.
    """
    ns = np.array([len(s) for s in sets], np.int64)
    shared = Shared(sets)
    cls = np.arange(len(ns))
    centre, away = np.zeros((2, len(ns)), np.int64)  # each set's leader, and how far it is from it
    leads, last = np.zeros(len(ns), bool), np.zeros(len(ns), np.int64)
    far = np.zeros(len(ns), np.int64)
    lows = np.searchsorted(100 * ns, percent * ns)
    for x in range(len(ns)):
        low = int(lows[x])
        near = np.flatnonzero(leads[:x] & (last[:x] >= low))
        far[near] = ns[x] + ns[near] - 2 * shared.of(x, near)
        limit = ns[x] + ns[low:x] - 2 * -(-percent * (ns[x] + ns[low:x]) // (100 + percent))  # as least_shared
        close = near[near >= low]
        close = close[far[close] <= limit[close - low]]
        for p in close.tolist():
            if cls[p] != cls[x]:
                yield x, p
                cls[cls == cls[p]] = cls[x]
        d, e = far[centre[low:x]], away[low:x]
        open_ = (cls[low:x] != cls[x]) & ~leads[low:x] & (np.abs(d - e) <= limit)
        certain = low + np.flatnonzero(open_ & (d + e <= limit))
        while len(certain):
            y = certain[0]
            yield x, int(y)
            cls[cls == cls[y]] = cls[x]
            certain = certain[cls[certain] != cls[x]]
        rest = low + np.flatnonzero(open_ & (d + e > limit) & (cls[low:x] != cls[x]))
        rest = rest[np.argsort(np.abs(d - e)[rest - low], kind="stable")]
        size = 16
        while len(rest):
            now, rest = rest[:size], rest[size:]
            for y in now[ns[x] + ns[now] - 2 * shared.of(x, now) <= limit[now - low]].tolist():
                if cls[y] != cls[x]:
                    yield x, y
                    cls[cls == cls[y]] = cls[x]
            rest, size = rest[cls[rest] != cls[x]], 2 * size
        if len(close):
            centre[x] = close[np.argmin(far[close])]
            away[x] = far[centre[x]]
        else:
            centre[x], leads[x] = x, True
        last[centre[x]] = x


def coarse_links(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b) of distinct sets that share a prefix shingle and may link: a forest for each index list."""
    places = heads.select("id", "n", F.posexplode("head").alias("at", "token"))
    lists = places.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = places.join(lists, "token").join(heads.select("id", "map"), "id")
    rows = blocked(rows, F.ceil(F.col("k") / LIST), F.col("id")).select("token", "_i", "_j", "n", "id", "at", "map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 3):
            keys = [t.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if t.num_rows > 1 else []
            cuts = [0, *map(int, new), t.num_rows]
            ns, ids, at, maps = t.column("n").to_pylist(), t.column("id").to_pylist(), t.column("at").to_pylist(), t.column("map").to_pylist()
            a, b = [], []
            for i, j in zip(cuts, cuts[1:]):
                if j - i > 1:
                    for x, y in candidate_links(ns[i:j], at[i:j], maps[i:j], percent):
                        a.append(ids[i + x])
                        b.append(ids[i + y])
            yield pa.record_batch([pa.array(a, t.schema.field("id").type), pa.array(b, t.schema.field("id").type)], names=["a", "b"])

    kind = heads.schema["id"].dataType.simpleString()
    return rows.repartition("token", "_i", "_j").sortWithinPartitions("token", "_i", "_j", "n", "at", "id").mapInArrow(run, f"a {kind}, b {kind}")


def maybe_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose _id may be among `ids`, so that few other texts are shuffled to meet them: one bit of FILTER
    tells it, and those that pass by chance find no partner later. The bits are FILTER / 64 rows at most, whatever the
    input, and may be broadcast."""
    place = F.pmod(F.xxhash64("_id"), F.lit(FILTER))
    bits = ids.select(F.floor(place / 64).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_id), {FILTER}) % 64 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    d = docs.withColumn("_word", F.floor(place / 64)).join(F.broadcast(bits), "_word")
    return d.where(F.expr(f"shiftright(_bits, cast(pmod(xxhash64(_id), {FILTER}) % 64 as int)) & 1 = 1")).drop("_word", "_bits")


def verified_links(docs: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of exact links that hold each family's classes together."""
    kind = docs.schema["_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = shingle_sets(b.column(2), size)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["family", "id", "bytes", "n", "items"])

    sizes = families.groupBy("family").agg((F.sum("n") * 8).alias("bytes"), F.count(F.lit(1)).alias("k"))
    own = families.join(sizes, "family").select(F.col("node").alias("_id"), "family", F.ceil(F.greatest(F.col("bytes") / BLOCK, F.col("k") / LIST)).alias("blocks"))
    rows = maybe_among(docs, families.select(F.col("node").alias("_id"))).join(own, "_id").select("family", "_id", "_text", "blocks").mapInArrow(sets, f"family {kind}, id {kind}, bytes long, n long, items binary")
    rows = blocked(rows, F.col("bytes"), F.col("id")).select("family", "_i", "_j", "n", "id", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 3):
            keys = [t.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if t.num_rows > 1 else []
            cuts = [0, *map(int, new), t.num_rows]
            ids, items = t.column("id").to_pylist(), t.column("items").to_pylist()
            a, b = [], []
            for i, j in zip(cuts, cuts[1:]):
                for x, y in exact_links([np.frombuffer(s, np.uint64) for s in items[i:j]], percent):
                    a.append(ids[i + x])
                    b.append(ids[i + y])
            yield pa.record_batch([pa.array(a, t.schema.field("id").type), pa.array(b, t.schema.field("id").type)], names=["a", "b"])

    return rows.repartition("family", "_i", "_j").sortWithinPartitions("family", "_i", "_j", "n", "id").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links lead to.

    Sets of word shingles (A-Z in lower case; words are runs without ASCII white space) link when 100 times what
    they share is at least `percent` times their union. Equal sets are one node. Nodes meet in index lists of their
    rarest shingles, where block skipping by size, place and bitmap leaves families that may link; the sets of
    a family are then compared exactly, with answers derived from those of similar sets. No link between
    different sets is lost: a class keeps as many links as hold it together. Lists and families beyond
    LIST sets or BLOCK bytes are split into pairs of blocks.

    Null or wordless texts: 0 shingles, linked with nothing. Rows of equal id are given one by one. A null id has
    no component. Very long texts are hashed in slices and compared whole. Other columns, whatever their names, are
    not read. Empty table: empty result.
    """
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    sets = written(prefixes(d, bin_counts(d, size), size, percent), "sets")
    # equal sets have equal bitmaps and prefixes, so any row's will do
    of_set = sets.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("map").alias("map"), F.first("head").alias("head"))
    of_set = written(of_set, "distinct-sets")
    heads, reps = of_set.select("id", "n", "map", "head"), of_set.select("s1", "s2", "n", F.col("id").alias("rep"))
    families = components(coarse_links(heads, percent))
    families = written(families.withColumnRenamed("component", "family").join(heads.select(F.col("id").alias("node"), "n"), "node"), "families")
    links = verified_links(d, families, size, percent)
    named = written(components(links), "components")
    found = sets.join(reps, ["s1", "s2", "n"], "left").join(named, F.col("rep") == F.col("node"), "left")
    out = found.select("id", "n", F.coalesce("component", "rep", "id").alias("component"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest id (null ids come last; of equal ids the
    smallest hash of the text, then any one). Rows without words all stay.

    Where ids are null or repeated, rows are told apart by a number, in a copy of the table, and are members like others.
    """
    key, rows = doc_id, docs
    if not docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where(F.col(doc_id).isNull() | (F.col("n") > 1)).isEmpty():
        key, rows = "__row", written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    named = near_duplicates(rows, key, text, **how).select(F.col(key).alias("__key"), F.col("component_id").alias("__class"))
    if key == doc_id:  # the class is named by its smallest id
        return rows.join(named.where("__key = __class").select(F.col("__key").alias("__row")), F.col(doc_id) == F.col("__row"), "left_semi")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col("__row").alias("row"))
    first = rows.select("__row", order.alias("__order")).join(named, F.col("__row") == F.col("__key")).groupBy("__class").agg(F.min("__order").alias("__first"))
    return rows.join(first.select(F.col("__first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)
