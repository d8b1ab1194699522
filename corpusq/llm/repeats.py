"""Suffix-array dedup: strings that stand more than once in a corpus, found and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, groups_of, utf8, written

LENGTH, GRAM = 200, 64
#: Bytes hashed at once; longer texts are cut into pieces that overlap.
PIECE = 1 << 20
#: Contexts that one task scans as a group; larger groups are split by what their members share.
GROUP = 10_000
#: Contexts of a group nearer to each other than this are compared in pairs.
NEAR = 128
#: A gram is hot above so many places, and above this share of all; its places are then dealt to SALTS tasks.
HOT, HOT_SHARE, SALTS = 10_000, 1e-5, 32
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def pieces(ends: np.ndarray, overlap: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the pieces, all but the last of a text being PIECE long."""
    out = []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        while b - a > PIECE:
            out.append((i, a, a + PIECE))
            a += PIECE - overlap
        out.append((i, a, b))
    return out


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position, bytes of context before, after, hash of the gram, hash of its context) of each anchor.

    An anchor is a gram whose hash is the smallest of all grams of some string of `length` bytes around it. Equal
    strings have equal anchors, so each string that stands twice holds an anchor that stands twice as well. The
    context is what such strings can reach: `length` - `gram` bytes before and `length` bytes from its start. Where
    pieces of a text overlap, an anchor is given by one of them only.
    """
    reach, spread = length - gram, length - gram + 1
    overlap = 2 * length + gram
    todo = [p for p in pieces(ends, overlap) if p[2] - p[1] >= length]
    while todo:
        taken, size = 0, 0
        while taken < len(todo) and (not taken or size + todo[taken][2] - todo[taken][1] <= PIECE):
            size += todo[taken][2] - todo[taken][1]
            taken += 1
        now, todo = np.array(todo[:taken], np.int64), todo[taken:]
        joined = np.concatenate([data[a:b] for _, a, b in now.tolist()])
        stop = np.cumsum(now[:, 2] - now[:, 1])
        start = stop - (now[:, 2] - now[:, 1])
        rolling = Rolling(joined)
        at = np.arange(len(joined) - gram + 1)
        h = np.full(len(joined), TOP)
        h[: len(at)] = rolling.of(at, at + gram)
        for j in range(1, gram):
            h[stop - j] = TOP
        least = sliding(h, spread, np.minimum)
        for j in range(1, length):  # strings that go on past their piece
            least[np.minimum(stop - j, len(least) - 1)] = np.where(stop - j < len(least), 0, least[-1])
        most = sliding(np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)]), spread, np.maximum)
        p = np.flatnonzero(most[: len(h)] == h)
        piece = np.searchsorted(stop, p, side="right")
        before, after = np.minimum(p - start[piece], reach), np.minimum(stop[piece] - p, length)
        text = now[piece, 0]
        whole = ((before == reach) | (now[piece, 1] == ends[text])) & ((after == length) | (now[piece, 2] == ends[text + 1]))
        # what lies far enough inside the next piece is the next one's
        whole &= (now[piece, 1] - start[piece] + p < now[piece, 2] - overlap + reach) | (now[piece, 2] == ends[text + 1])
        p, piece, before, after, text = p[whole], piece[whole], before[whole], after[whole], text[whole]
        context = rolling.of(p - before, p + after) ^ (before * 1024 + after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield text, p - start[piece] + now[piece, 1] - ends[text], before, after, h[p].view(np.int64), context.view(np.int64)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """_key, _text -> the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = utf8(b.column(1))
            for text, at, before, after, h, c in anchors_of(data, ends, length, gram):
                yield pa.record_batch([b.column(0).take(pa.array(text)), pa.array(at), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(h), pa.array(c)], names=["_key", "at", "before", "after", "h", "c"])

    return docs.select("_key", "_text").mapInArrow(run, "_key long, at long, before int, after int, h long, c long")


def shared(a: bytes, b: bytes) -> int:
    """How many leading bytes two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        k = (low + high) // 2
        if a[low:k] == b[low:k]:
            low = k
        else:
            high = k
    return low


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(what they share, first, last) of the intervals of the common-prefix tree over sorted strings, inner ones first,
    by one scan with a stack over what neighbours share."""
    stack: list[tuple[int, int]] = []  # (shared, first member) of open intervals
    for i in range(len(common) + 1):
        now, first = common[i] if i < len(common) else -1, i
        while stack and stack[-1][0] > now:
            share, first = stack.pop()
            yield share, first, i
        if i < len(common) and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[list[int], int, int]]:
    """Maximal repeat groups around one anchor: (all members, bytes before that they share, bytes after).

    `rights` go on from the anchor and are sorted: a suffix array, whose intervals share `right` bytes and no more.
    Whether the members go on alike to the left is tested by the intervals of their reversed left contexts: those of
    one such interval share `left` bytes, and the byte before is diverse or not known to some. Where left and right
    fill `length`, the group is given with every occurrence.
    """
    most = max(map(len, lefts), default=0)
    for right, i, j in intervals([shared(a, b) for a, b in zip(rights, rights[1:])]):
        if right + most < length:
            continue
        order = sorted(range(i, j + 1), key=lefts.__getitem__)
        for left, x, y in intervals([shared(lefts[a], lefts[b]) for a, b in zip(order, order[1:])]):
            if left + right >= length:
                yield order[x : y + 1], left, right


class Strings:
    """Strings as rows of 64-bit words, filled up with zeros."""

    def __init__(self, strings: pa.Array) -> None:
        strings = strings.cast(pa.binary())
        ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
        self.size = np.diff(ends).astype(np.int64)
        rows = np.zeros((len(strings), -(-max(1, int(self.size.max(initial=0))) // 8) * 8), np.uint8)
        rows[np.arange(rows.shape[1]) < self.size[:, None]] = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.words = rows.view("<u8")

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many leading bytes pairs of strings share."""
        differ = self.words[a] ^ self.words[b]
        word = (differ != 0).argmax(axis=1)
        at = differ[np.arange(len(a)), word]
        zeros = np.bitwise_count((at & (~at + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        return np.minimum(np.where(at == 0, self.words.shape[1] * 8, word * 8 + zeros), np.minimum(self.size[a], self.size[b]))


def covers(groups: np.ndarray, rights: pa.Array, lefts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of the anchor each member of each group is covered by repeats; 0 and 0 if not.

    Members are in order of `rights` in their group. In the deepest interval of `repeat_groups` around two members, these
    share as much as both do: so those near each other are looked at in pairs, all groups at once. Those that are NEAR
    places apart or more meet in intervals of more than NEAR members, where the left context that shares most with a
    member's stands next to it in order.
    """
    right, left = Strings(rights), Strings(lefts)
    out = np.zeros((2, len(groups)), np.int64)
    cuts = np.flatnonzero(np.diff(groups)) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    most = np.repeat(np.maximum.reduceat(left.size, starts), np.diff(np.append(starts, len(groups)))) if len(groups) else left.size
    rows = np.arange(max(0, len(groups) - 1))
    common = right.shared(rows, rows + 1)
    common[cuts - 1] = -1
    common[common + most[:-1] < length] = -1  # no repeat goes over such neighbours

    def cover(member: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        found = before + after >= length
        np.maximum.at(out[0], member[found], before[found])
        np.maximum.at(out[1], member[found], after[found])

    a, after = rows, common
    for d in range(1, NEAR):
        open_ = after >= 0
        a, after = a[open_], after[open_]
        before = left.shared(a, a + d)
        cover(np.concatenate([a, a + d]), np.tile(before, 2), np.tile(after, 2))
        inner = a + d < len(common)
        a, after = a[inner], after[inner]
        after = np.minimum(after, common[a + d])
    bounds = np.concatenate([[-1], np.flatnonzero(common < 0), [len(common)]])
    for i, j in zip((bounds[:-1] + 1).tolist(), bounds[1:].tolist()):
        if j - i < NEAR:
            continue
        names = lefts.slice(i, j - i + 1).to_pylist()
        order = np.array(sorted(range(len(names)), key=names.__getitem__))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for after, x, y in intervals(common[i:j].tolist()):
            if y - x >= NEAR and after >= 0:
                members = i + order[np.sort(place[x : y + 1])]
                before = left.shared(members[:-1], members[1:])
                cover(members, np.maximum(np.append(before, 0), np.append(0, before)), np.full(len(members), after))
    return out[0], out[1]


def windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Contexts of the anchors wanted (h, c, n, _key, at, before, after), cut from their texts."""
    by_key = wanted.groupBy("_key").agg(F.collect_list(F.struct("h", "c", "big", "at", "before", "after")).alias("w"))
    schema = pa.schema([("big", pa.bool_()), ("h", pa.int64()), ("c", pa.int64()), ("right", pa.binary()), ("left", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, wanted in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                t = (text.as_py() or "").encode()
                rows += [(w["big"], w["h"], w["c"], t[w["at"] : w["at"] + w["after"]], t[w["at"] - w["before"] : w["at"]][::-1]) for w in wanted]
                if len(rows) > 20_000:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.join(by_key, "_key").select("_doc", "_text", "w").mapInArrow(run, "big boolean, h long, c long, right binary, left binary")


def covers_in_tree(w: DataFrame, length: int) -> DataFrame:
    """Contexts by group -> how far each is covered; a group's contexts are sorted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 1):
            left, right = covers(t.column("g").to_numpy(), *(t.column(k).combine_chunks() for k in ("right", "left")), length)
            left, right = left.astype(np.int32), right.astype(np.int32)
            hit = right > 0
            yield pa.record_batch([pa.array(t.column("h").to_numpy()[hit]), pa.array(t.column("c").to_numpy()[hit]), pa.array(left[hit]), pa.array(right[hit])], names=["h", "c", "left", "right"])

    by_group = w.select("g", "h", "c", "right", "left").repartition("g").sortWithinPartitions("g", "right")
    return by_group.mapInArrow(run, "h long, c long, left int, right int")


def split_groups(w: DataFrame, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of large groups -> (tables of groups small enough for the tree, tables of covers).

    A group holds contexts that share `low` bytes to the right and `length` - `high` to the left: (`gram`, `length`) at
    first. It is split in two: repeats that go `middle` + 1 bytes to the right or more, and those that go no further
    than `middle`, which reach `length` - `middle` to the left. Each context goes to both halves, but only where
    another shares as much. Halves that are still too large are split again; where low = high all members are
    repeats, covered as far as they share. No pair is lost, and no group is gathered to split it.
    """
    small, done = [], []
    d = w.select("h", "c", "right", "left").withColumn("low", F.lit(gram)).withColumn("high", F.lit(length))
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct((middle + 1).alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
        d = d.withColumn("half", F.explode(halves)).select("h", "c", "right", "left", "half.low", "half.high")
        d = d.where((F.octet_length("right") >= F.col("low")) & (F.octet_length("left") >= length - F.col("high")))
        shares = [F.substring("right", F.lit(1), F.col("low")), F.substring("left", F.lit(1), F.lit(length) - F.col("high"))]
        d = written(d.withColumn("g", F.xxhash64("h", "low", "high", *shares)), "halves")
        sizes = written(d.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1), "half-sizes")
        d = d.join(sizes, "g")
        done.append(d.where("low = high").select("h", "c", (length - F.col("high")).alias("left"), F.col("low").alias("right")))
        small.append(d.where((F.col("low") < F.col("high")) & (F.col("k") <= GROUP)).select("g", "h", "c", "right", "left"))
        d = d.where((F.col("low") < F.col("high")) & (F.col("k") > GROUP)).drop("g", "k")
        if d.isEmpty():
            return small, done


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the maximal removed runs, in bytes) and kept (the bytes left), of
    every row of `docs`.

    A byte goes if a string of `length` bytes over it also starts elsewhere, in the same text or another; texts are
    taken as UTF-8, strings do not cross texts and are judged on the input.

    Anchors (about one in 70 bytes) stand for the strings around them. Those that stand once are dropped; those
    that stand with the same context twice cover it whole, and are counted before anything is shuffled. Only
    one context of each kind is cut from its text, sorted with those of the same anchor, and scanned for
    maximal repeats by the common-prefix interval tree. Anchors with more than GROUP contexts are split by what
    their contexts share, so that each part is scanned in the same way.

    Null text: no bytes. Rows that repeat in id and text are copies of each other: both are cut. A text without
    repeats has no spans and is kept whole. Runs of one byte are repeats of themselves like others. Very long texts
    are hashed in pieces that overlap. Other columns, whatever their names, are not read. Empty table: empty result.
    Rows are told apart by a 64-bit hash of id and text.
    """
    d = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    a = anchors(d, length, gram)
    twice = written(a.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "grams")
    limit = max(HOT, HOT_SHARE * (twice.agg(F.sum("n")).first()[0] or 0))
    hot = twice.where(F.col("n") > limit).select("h", F.lit(True).alias("hot"))  # 1 / HOT_SHARE rows at most
    dealt = a.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_key", "at"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = twice.select("h", F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    found = written(dealt.join(salts, ["h", "salt"]).drop("salt"), "anchors")
    kinds = found.groupBy("h", "c").agg((F.count(F.lit(1)) > 1).alias("many"), F.min(F.struct("_key", "at", "before", "after")).alias("one"))
    kinds = written(kinds.select("h", "c", "many", "one.*"), "contexts")
    size = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    wanted = kinds.join(size, "h").withColumn("big", F.col("k") > GROUP)
    w = written(windows(d, wanted, length), "windows")
    small, done = split_groups(w.where("big"), length, gram)
    in_tree = w.where(~F.col("big")).select(F.col("h").alias("g"), "h", "c", "right", "left")
    for x in small:
        in_tree = in_tree.unionByName(x)
    far = kinds.where("many").select("h", "c", F.col("before").alias("left"), F.col("after").alias("right")).unionByName(covers_in_tree(in_tree, length))
    for x in done:
        far = far.unionByName(x)
    far = far.groupBy("h", "c").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    spans = found.join(far, ["h", "c"]).groupBy("_key").agg(F.collect_list(F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))).alias("s"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            data, ends = utf8(b.column(1))
            lists, kept = [], []
            for i, s in enumerate(b.column(2)):
                t, runs = data[ends[i] : ends[i + 1]].tobytes(), []
                if s.is_valid:
                    starts = s.values.field("start").to_numpy()
                    order = np.argsort(starts, kind="stable")
                    starts, stops = starts[order], np.maximum.accumulate(s.values.field("end").to_numpy()[order])
                    new = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
                    runs = list(zip(starts[new].tolist(), stops[np.append(new[1:] - 1, len(stops) - 1)].tolist()))
                at, parts = 0, []
                for x, y in runs:
                    parts.append(t[at:x])
                    at = y
                kept.append(b"".join([*parts, t[at:]]))
                lists.append([{"start": x, "end": y} for x, y in runs])
            yield pa.record_batch([b.column(0), pa.array(np.diff(ends)), pa.array(lists, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    out = d.join(spans, "_key", "left").select("_doc", "_text", "s").mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.toDF(doc_id, "n_bytes", "spans", "kept")
