"""Shared pieces: the cluster's shared folder, written tables, and words of a text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and Spark runs in one
    process, a temporary one. A cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="corpusq-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths that this process has handed out.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/corpusq/{name}-{uuid.uuid4().hex}")
    return _made[-1]


class Tables:
    """The tables that some steps have written for themselves, to be removed when a later step reads their result from
    elsewhere."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def kept(self, step, *args) -> DataFrame:
        """Runs a step and remembers what it wrote."""
        start = len(_made)
        out = step(*args)
        self.paths += _made[start:]
        return out

    def remove_unless_read_by(self, df: DataFrame) -> None:
        if not self.paths or any("/" + p.strip("/").rsplit("/", 1)[-1] + "/" in f for f in df.inputFiles() for p in self.paths):
            return
        spark = df.sparkSession
        for p in self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, its size is known to the
    optimizer, and lost executors cost no more than the tasks that run."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def words(text: str | Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array one after the other, and where each text ends (with a 0 in front)."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    return np.frombuffer(t.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
#: A random-looking word for each byte value.
BYTE = mixed_bits(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.ones((2, size), np.uint64)
        steps[0, 1:], steps[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
        _powers[:] = np.cumprod(steps, axis=1)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Rolling:
    """Polynomial hashes of any stretch of some bytes, 64 bits wide."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed_bits((self.sums[end] - self.sums[start]) * self.down[start])


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches cut so that rows that agree in the first `keys` columns stay together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1] for k in range(keys)]
        same = np.ones(b.num_rows, bool)
        for k in range(keys):
            same &= pc.equal(b.column(k), last[k]).to_numpy(zero_copy_only=False)
        cut = b.num_rows - int(same.sum())
        if cut or (held and any(held[-1].column(k)[held[-1].num_rows - 1] != last[k] for k in range(keys))):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
