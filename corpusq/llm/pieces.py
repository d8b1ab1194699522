"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, SPACE = "▁", 0x20
#: Words of which a worker remembers the ids from batch to batch.
KNOWN = 200_000


class Pieces:
    """A model's pieces: a trie of (children, id, score), byte pieces, and the bytes of each id. A space stands for
    the mark, so that a mark in the text itself is a character without a piece."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: dict[int, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
                continue
            self.bytes.append(piece.replace(MARK, " ").encode())
            self.score[i] = sp.get_score(i)
        self.unknown = min(self.score.values()) - 10.0
        self.known: dict[str, tuple[int, ...]] = {}
        self.table = pa.array(self.bytes, pa.binary())

    @cached_property
    def root(self) -> list:
        """The trie; a worker that only decodes has none."""
        root: list = [{}, -1, 0.0]
        for i, score in self.score.items():
            node = root
            for c in self.bytes[i].decode():
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = i, score
        return root

    def encode_sorted(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words in sorted order. A word keeps the scores of the prefix that it shares with the one before.

        best[d] is the best score of the first d characters and back[d] where its last piece starts and its id;
        open[d] holds the starts from which a piece may go on, with their places in the trie.
        """
        found: dict[str, tuple[int, ...]] = {}
        best, back, opened, last, root, unknown = [0.0], [(0, -1)], [[]], "", self.root, self.unknown
        for word in words:
            d, most = 0, min(len(word), len(last))
            while d < most and word[d] == last[d]:
                d += 1
            del best[d + 1 :], back[d + 1 :], opened[d + 1 :]
            for k in range(d, len(word)):
                c, top, where, going = word[k], float("-inf"), (k, -1), []
                for start, node in [*opened[k], (k, root)]:
                    if (to := node[0].get(c)) is not None:
                        going.append((start, to))
                        if to[1] >= 0 and (s := best[start] + to[2]) > top:
                            top, where = s, (start, to[1])
                if c not in root[0] or root[0][c][1] < 0:  # no piece of its own: bytes
                    if (s := best[k] + unknown) > top:
                        top, where = s, (k, -1)
                best.append(top)
                back.append(where)
                opened.append(going)
            ids, at = [], len(word)
            while at:
                start, i = back[at]
                ids.extend((i,) if i >= 0 else [self.byte_id[x] for x in reversed(word[start].encode())])
                at = start
            found[word] = tuple(reversed(ids))
            last = word
        return found

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        new = self.encode_sorted(sorted(w for w in words if w not in self.known))
        ids = [self.known.get(w) or new[w] for w in words]
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
        if len(new) <= KNOWN:
            self.known |= new
        return ids


#: Bytes of text, or ids, that are worked on at once: their arrays take a multiple of that.
SLICE = 1 << 20


@lru_cache(maxsize=4)
def pieces_of(proto: bytes) -> Pieces:
    return Pieces(proto)


def load(spark: SparkSession, model: str = MODEL) -> Broadcast:
    """The model file (its size is that of the vocabulary) for the tasks; executors need no path to it."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def marked_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts, each with a space in front, as (words of each text, words as a dictionary array).

    No piece goes on past the end of a word, so a text is cut before each run of spaces.
    """
    large = lambda x: pa.scalar(x, pa.large_string())
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    t = pc.if_else(pc.equal(plain, large("")), plain, pc.binary_join_element_wise(large(""), plain, large(" ")))
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2] or b"", np.uint8)[: ends[-1]]
    space = data == SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(first)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1])), t.buffers()[2]])
    return np.diff(np.searchsorted(starts, ends)), words.dictionary_encode()


def encoded(p: Pieces, texts: pa.Array) -> pa.ListArray:
    per_text, words = marked_words(texts)
    ids = p.ids_of(words.dictionary.to_pylist())
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
    begin = np.cumsum(size) - size
    at = words.indices.to_numpy(zero_copy_only=False)
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    gathered = flat[np.repeat(begin[at] - (ends - n), n) + np.arange(total)]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(gathered))


def decoded(p: Pieces, ids: pa.ListArray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    parts = p.table.cast(pa.large_binary()).take(ids.flatten())
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    ends = ends[bounds]
    starts = ends[:-1][np.diff(ends) > 0]
    dropped = starts[data[starts] == SPACE]
    ends = ends - np.searchsorted(dropped, ends)
    joined = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(np.delete(data, dropped))])
    try:
        text = joined.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that end inside a character
        text = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())
    return pc.if_else(ids.is_valid(), text, None).cast(pa.string())


def sliced(b: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose sizes add up to about SLICE; a row above that is a slice's last."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), b.num_rows]
    return (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, to: str = "token_ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the ids of each whole text, an array<int>; nothing is shuffled.

    The ids are those of the segmentation with the highest sum of piece scores; of equal ones, the longest last
    piece wins. White space is kept as it is, a space is put in front, characters without a piece become bytes.
    Each slice of a batch sorts its distinct marked words, so that the search runs along a trie of them.
    Texts are not normalised. Null or empty texts have no ids; very long texts are encoded whole; rows that repeat are
    encoded alike. Other columns stay but for `drop`; one named like `to` is replaced.
    """
    shared = load(docs.sparkSession, model)
    keep = [f for f in docs.schema.fields if f.name != to and f.name not in drop]
    d = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias(free_name(docs, "_encoded")))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{to}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(shared.value)
        for b in (x for whole in batches for x in sliced(whole, pc.binary_length(whole.column(whole.num_columns - 1)))):
            yield pa.record_batch([*b.columns[:-1], encoded(p, b.column(b.num_columns - 1))], names=[*(f.name for f in keep), to])

    return d.mapInArrow(run, fields)


def decode(df: DataFrame, ids: str = "token_ids", model: str = MODEL, to: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the text of each array of ids; of a null array, null; of an empty one, the empty text. Ids that end inside a
    character give a replacement character. Other columns stay but for `drop`; one named like `to` is replaced."""
    shared = load(df.sparkSession, model)
    keep = [f for f in df.schema.fields if f.name != to and f.name not in drop]
    d = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{ids}`").alias(free_name(df, "_decoded")))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{to}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(shared.value)
        for b in (x for whole in batches for x in sliced(whole, pc.list_value_length(whole.column(whole.num_columns - 1)))):
            yield pa.record_batch([*b.columns[:-1], decoded(p, b.column(b.num_columns - 1))], names=[*(f.name for f in keep), to])

    return d.mapInArrow(run, fields)
