"""MinHash near-duplicates by an LSH forest: sorted orders of signatures, and neighbours by what they share in front."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, mixed_bits, written
from .graph import components
from .jaccard import shingle_sets, verified_links

SIZE, PERCENT = 2, 80
#: Orders of the signatures, and how many values neighbours share in front. Two sets of similarity s share DEPTH values
#: in no order with a chance of (1 - s^DEPTH)^TREES: 3e-6 at 0.8, 2e-8 at 0.85.
TREES, DEPTH = 24, 4
#: Sets that one task compares as a region; where more share DEPTH values, more values are asked for, at most DEEPEST.
REGION, DEEPEST = 2000, 64
#: Standard deviations by which the values two signatures share may fall short of the similarity asked for.
SLACK = 4.5


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The `size` MinHash values of each set that is not empty, 32 bits each."""
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    seeds = mixed_bits(np.arange(1, 2 * size + 1, dtype=np.uint64))
    out = np.empty((len(sets), size), np.uint32)
    for j in range(size):
        out[:, j] = np.minimum.reduceat(((hashes ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint64(1))) >> np.uint64(32), starts)
    return out


def signed_sets(docs: DataFrame, size: int, values: int) -> DataFrame:
    """_id, _text -> id, set (128-bit hash as two longs), n and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            made: list[bytes | None] = [None] * len(sets)
            full = [k for k, s in enumerate(sets) if len(s)]
            for a in range(0, len(full), 256):
                for k, s in zip(full[a : a + 256], signatures([sets[k] for k in full[a : a + 256]], values)):
                    made[k] = s.tobytes()
            yield pa.record_batch([b.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(made, pa.binary())], names=["id", "s1", "s2", "n", "sig"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(run, f"id {kind}, s1 long, s2 long, n long, sig binary")


def places(sets: DataFrame, trees: int, depth: int, asked: int) -> DataFrame:
    """id, sig, and tree where `sets` has it -> (tree, key, id): the place of a set in each order, or in that of `tree`, by its
    first `asked` values. Order t takes the values from t * depth on and goes round."""
    given = "tree" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            row = np.arange(b.num_rows) if given else np.repeat(np.arange(b.num_rows), trees)
            tree = b.column(2).to_numpy().astype(np.int64) if given else np.tile(np.arange(trees), b.num_rows)
            key = mixed_bits(tree.astype(np.uint64) + np.uint64(1))
            for j in range(asked):
                key = mixed_bits(key ^ sig[row, (tree * depth + j) % sig.shape[1]])
            yield pa.record_batch([pa.array(tree.astype(np.int32)), pa.array(key.view(np.int64)), b.column(0).take(pa.array(row))], names=["tree", "key", "id"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "sig", *(["tree"] if given else [])).mapInArrow(run, f"tree int, key long, id {kind}")


def maybe_links(ns: np.ndarray, sigs: np.ndarray, classes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A forest over sets in order of size, of pairs whose sizes and signatures allow a link. Sets of one class (given, or
    joined on the way) are not compared: a set is held against all sets of other classes at once."""
    cls = np.unique(classes, return_inverse=True)[1]
    k = sigs.shape[1]
    enough = percent / 100 * k - SLACK * (k * percent / 100 * (1 - percent / 100)) ** 0.5
    low = np.searchsorted(100 * ns, percent * ns)
    for x in range(1, len(ns)):
        rest = low[x] + np.flatnonzero(cls[low[x] : x] != cls[x])
        if len(rest):
            rest = rest[(sigs[rest] == sigs[x]).sum(axis=1) >= enough]
        while len(rest):
            yield x, int(rest[0])
            cls[cls == cls[rest[0]]] = cls[x]
            rest = rest[cls[rest] != cls[x]]


def links_in(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, cls, n, id, sig) -> (a, b) of sets of a group that may link: a forest for each, over the classes given."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, len(keys)):
            own = [t.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in own], axis=0)) + 1 if t.num_rows > 1 else []
            ids, sigs = t.column("id").combine_chunks(), np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1).astype(np.uint8)
            ns, cls, a, b = t.column("n").to_numpy(), t.column("cls").to_numpy(), [], []
            for i, j in zip([0, *map(int, new)], [*map(int, new), t.num_rows]):
                for x, y in maybe_links(ns[i:j], sigs[i:j], cls[i:j], percent):
                    a.append(i + x)
                    b.append(i + y)
            yield pa.record_batch([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return rows.select(*keys, "cls", "n", "id", "sig").repartition(*keys).sortWithinPartitions(*keys, "n", "id").mapInArrow(run, f"a {kind}, b {kind}")


def blocks_of(n: str) -> Column:
    return F.ceil(F.col(n) / REGION)


def dense_rest(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets that may link, of the pairs of dense regions (key, id) that no deeper region has compared.

    Pairs that `links` already join need no look, so a region that is one class, as a group of near copies becomes, has
    nothing left. In others the members stand in blocks, those of large classes in blocks of their own; blocks meet in
    pairs unless both are of the same class.
    """
    named = components(links)
    m = members.join(named.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce(F.xxhash64("component"), F.xxhash64("id")).alias("cls"))
    m = written(m, "dense-members")
    sizes = m.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.sum("c").alias("k"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    solo = F.when(F.col("c") > REGION, F.col("cls"))
    sizes = written(sizes.join(open_, "key").select("key", "cls", "c", "k", solo.alias("solo")), "dense-classes")
    block = F.when(F.col("solo").isNull(), F.pmod(F.xxhash64("cls"), blocks_of("k"))).otherwise(F.xxhash64("cls", F.pmod(F.xxhash64("id"), blocks_of("c"))))
    placed = written(m.join(sizes, ["key", "cls"]).select("key", "cls", "id", "solo", block.alias("block")), "dense-blocks")
    listed = placed.select("key", "block", "solo").distinct()
    other = listed.select("key", F.col("block").alias("other"), F.col("solo").alias("other_solo"))
    pairs = listed.join(other, "key").where("block <= other and not coalesce(solo = other_solo, false)").select("key", "block", "other")
    both = pairs.select("key", "block", F.col("block").alias("i"), F.col("other").alias("j")).unionByName(pairs.where("block < other").select("key", F.col("other").alias("block"), F.col("block").alias("i"), F.col("other").alias("j")))
    rows = placed.join(both, ["key", "block"]).join(sets.select("id", "n", "sig"), "id")
    return links_in(rows, ["key", "i", "j"], percent)


def forest_links(sets: DataFrame, percent: int, trees: int, depth: int) -> DataFrame:
    """(a, b) of distinct sets (id, n, sig) that may link, as forests that keep each class of such links together.

    In each order the sets that share `depth` values in front are a region. Where it holds more than REGION sets, twice
    as many values are asked for, and so on; what still is larger is dealt into blocks. The pairs that deeper regions
    leave out are compared in `dense_rest`, unless they are joined by then.
    """
    sized = sets.select("id", "n", "sig", F.xxhash64("id").alias("cls"))
    at, asked, parts, dense = written(places(sets, trees, depth, depth), "places"), depth, [], None
    while True:
        counts = written(at.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "regions")
        parts.append(at.join(counts.where(F.col("k") <= REGION), "key").select("key", "id"))
        large = at.join(counts.where(F.col("k") > REGION), "key")
        if counts.where(F.col("k") > REGION).isEmpty():
            break
        large = written(large, "dense")
        dense = large.select("key", "id") if dense is None else dense
        if asked >= min(DEEPEST, trees * depth):
            parts.append(large.select(F.xxhash64("key", F.pmod(F.xxhash64("id"), blocks_of("k"))).alias("key"), "id"))
            break
        asked *= 2
        at = written(places(large.select("id", "tree").join(sets.select("id", "sig"), "id"), trees, depth, asked), "places")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    links = written(links_in(rows.join(sized, "id"), ["key"], percent), "maybe-links")
    return links if dense is None else links.unionByName(dense_rest(dense, sets, links, percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and kept (whether that is the row's own).

    Sets of word shingles (A-Z in lower case; words are runs without ASCII white space) link when 100 times what they
    share is at least `percent` times their union. Equal sets are one node. Of each set `trees` * `depth` MinHash values
    are taken; the sets stand in `trees` orders of them, and those that share enough values in front are candidates:
    `depth` of them, more where the order is dense. Candidates whose signatures allow it are grouped into families, and
    the full sets of a family are compared exactly: every link given is certain. A pair of similarity s is no candidate
    with a chance of (1 - s^depth)^trees, and then only matters if no other links join its ends.

    Null or wordless texts: 0 shingles, linked with nothing. Rows of equal id are given one by one. A row without id links
    with nothing, but where its set equals that of a row with an id it has that row's component and is not kept. Very long texts are hashed in slices and compared whole. Other columns, whatever their names,
    are not read. Empty table: empty result.
    """
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = written(signed_sets(d, size, trees * depth), "signed-sets")
    of_set = rows.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    of_set = written(of_set, "distinct-sets")
    families = components(forest_links(of_set.select("id", "n", "sig"), percent, trees, depth))
    families = written(families.withColumnRenamed("component", "family").join(of_set.select(F.col("id").alias("node"), "n"), "node"), "families")
    named = written(components(verified_links(d, families, size, percent)), "components")
    reps = of_set.select("s1", "s2", "n", F.col("id").alias("rep"))
    found = rows.drop("sig").join(reps, ["s1", "s2", "n"], "left").join(named, F.col("rep") == F.col("node"), "left")
    out = found.select("id", "n", F.coalesce("component", "rep", "id").alias("component"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))
