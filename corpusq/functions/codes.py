"""Texts as arrays of code points: what a character is stands in a table, and counts are made for many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A code point that no text has: one stands after each text.
END_OF_TEXT = 0x110000
#: Bytes of text that are worked on at once: their arrays take a multiple of that.
SLICE = 1 << 20

_tables: dict[tuple[str, ...], np.ndarray] = {}


def table(spark: SparkSession, patterns: tuple[str, ...]) -> np.ndarray:
    """For each code point, bits that tell which of the patterns, each for one character, it fits. Spark's own patterns
    are asked, so that a character is the same here as in its expressions; made once in a process."""
    if patterns not in _tables:
        c = spark.range(END_OF_TEXT).where("id not between 55296 and 57343")
        c = c.select(F.col("id").cast("int").alias("at"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        bits = F.lit(0)
        for i, p in enumerate(patterns):
            bits = bits.bitwiseOR(F.when(F.col("c").rlike(p), 1 << i).otherwise(0))
        found = c.select("at", bits.alias("bits")).where("bits <> 0").toArrow()  # no more rows than there are characters
        made = np.zeros(END_OF_TEXT + 1, np.int32)
        made[found["at"].to_numpy()] = found["bits"].to_numpy()
        _tables[patterns] = made
    return _tables[patterns]


def sliced(sizes: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of rows whose sizes add up to about `limit`; a row above that is a stretch's last."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // (limit or SLICE))) + 1).tolist(), len(sizes)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if j > i)


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, END_OF_TEXT after each, and where each text begins; null is empty."""
    each = [(x or b"").decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
    code = np.insert(np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), ends, END_OF_TEXT)
    return code, np.concatenate([[0], ends + np.arange(1, len(each) + 1)])


def counter(of: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    """A function of texts that gives a struct of whole numbers for each, by `of`(code points, bounds of the texts)."""

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        done = [of(*points(texts.slice(i, j - i))) for i, j in sliced(pc.binary_length(texts))]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([d[n] for d in done] or [[]]), pa.int64()) for n in names], list(names))

    return run


def counted(df: DataFrame, text: str, to: str, of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...], made: np.ndarray) -> DataFrame:
    """Adds a struct of counts of each text by `of`(what each code point is, code points, bounds); `made` is sent to the
    tasks once. The counts are made once for a row, however many expressions read them."""
    shared = df.sparkSession.sparkContext.broadcast(made)
    count = F.arrow_udf(lambda texts: counter(lambda code, bounds: of(shared.value, code, bounds), names)(texts), ", ".join(f"{n} long" for n in names))
    return df.withColumn(to, count.asNondeterministic()(F.col(text)))


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), bounds))


def long_runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, code point) of each longest run of three or more equal characters."""
    same = np.append(code[1:] == code[:-1], [False, False])  # as the next one
    at = np.flatnonzero(same[:-1] & same[1:])
    start, last = at[(at == 0) | ~same[at - 1]], at[~same[at + 2]] if len(at) else at
    return start, last - start + 3, code[start]
