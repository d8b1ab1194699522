"""The chunkers as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusq.operators import chunking
from corpusq.functions.text import PROFILES

ROWS = "chunk_index int, total_chunks int, chunk_text string"


def rows(made: list[str]) -> Iterator[tuple[int, int, str]]:
    return ((i, len(made), c) for i, c in enumerate(made))


@udtf(returnType=ROWS, useArrow=True)
class PackChunks:
    """pack_chunks(text, size, overlap, tokens): segments packed into chunks with overlap."""

    def eval(self, text: str, size: int, overlap: int, tokens: int) -> Iterator[tuple[int, int, str]]:
        yield from rows(chunking.pack(text, size, overlap, tokens))


@udtf(returnType=ROWS, useArrow=True)
class AdaptiveChunks:
    """adaptive_chunks(text, profile, size, overlap, tokens): by profile; a null size, overlap or tokens is the profile's."""

    def eval(self, text: str, profile: str, size: int, overlap: int, tokens: int) -> Iterator[tuple[int, int, str]]:
        own = PROFILES.get(profile, PROFILES["general"])
        yield from rows(chunking.adaptive(text, profile, *(b if a is None else a for a, b in zip((size, overlap, tokens), own))))


@udtf(returnType=ROWS, useArrow=True)
class RecursiveChunks:
    """recursive_chunks(text, size, overlap): cut at the coarsest separators."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        yield from rows(chunking.recursive(text, size, overlap))


#: Names under which SQL finds them.
FUNCTIONS = {"pack_chunks": PackChunks, "adaptive_chunks": AdaptiveChunks, "recursive_chunks": RecursiveChunks}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the table functions known to the session: `SELECT ... FROM t, LATERAL pack_chunks(t.text, 1200, 180, 500)`, with
    other parameters for each row if wanted. A text without chunks gives no row."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(prefix + name, function)
    return [prefix + n for n in FUNCTIONS]
