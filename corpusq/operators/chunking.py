"""Texts into chunks: sentences natively, packing with overlap in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.codes import sliced

#: Where paragraphs and sentences end.
PARAGRAPH, SENTENCE = r"\n\s*\n+", r"(?<=[.!?。！？])\s+"
#: Where tables begin, what code is, and separators from coarse to fine.
TABLE, CODE, SEPARATORS = r"\n(?=\[Sheet:|\||\d+,)", r"(?s)(```.*?```|`[^`\n]+`)", ("\n\n", "\n", ". ", " ", "")


def sentence_array(text: Column) -> Column:
    """The sentences of a text that are not blank, trimmed; null for null."""
    return F.filter(F.transform(F.split(text, SENTENCE, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence that is not blank, trimmed, with its place from 0; none for null."""
    return docs.select(key, F.posexplode(sentence_array(F.col(text))).alias("sentence_index", "sentence"))


def segments(text: str, size: int, overlap: int) -> Iterator[str]:
    """Sentences; those longer than a chunk as runs of words, or as slices where there is one word."""
    for paragraph in re.split(PARAGRAPH, text):
        for s in filter(None, (x.strip() for x in re.split(SENTENCE, paragraph))):
            words = s.split()
            if len(s) <= size:
                yield s
            elif len(words) == 1:
                yield from (s[i : i + size] for i in range(0, len(s), max(size - overlap, 1)))
            else:
                run, n = [], -1
                for w in words:
                    if run and n + 1 + len(w) > size:
                        yield " ".join(run)
                        run, n = [], -1
                    run.append(w)
                    n += 1 + len(w)
                yield " ".join(run)


def pack(text: str | None, size: int, overlap: int, tokens: int) -> list[str]:
    """Segments fill a chunk up to its characters and tokens; the next begins with the end of the one before."""
    done: dict[str, None] = {}
    held: list[str] = []
    n = 0
    for s in segments((text or "").strip(), size, overlap):
        more = n + len(s) + bool(held)
        if held and (more > size or max(1, more // 4) > tokens):
            chunk = " ".join(held).strip()
            done[chunk] = None
            tail = chunk[-overlap:].strip() if overlap > 0 else ""
            held = [tail, s] if tail else [s]
            n = len(" ".join(held))
        else:
            held.append(s)
            n = more
    if last := " ".join(held).strip():
        done[last] = None
    return list(done)


def chunk_rows(d: DataFrame, rows_of: Callable[..., Iterator[tuple]], made: str) -> DataFrame:
    """(key, columns of `made`) by `rows_of`(key, text, ...), which gives rows for one. A batch is worked on in slices of
    about codes.SLICE bytes of text, each handed on as it is done: memory follows the slice, not the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "string": pa.string()}
        for b in batches:
            names, types = [b.schema.names[0]], [b.schema.types[0]]
            for name, kind in (x.split() for x in made.split(", ")):
                names, types = [*names, name], [*types, kinds[kind]]
            for i, j in sliced(pc.binary_length(b.column(1))):
                rows = [r for of in zip(*(c.to_pylist() for c in b.slice(i, j - i).columns), strict=True) for r in rows_of(*of)]
                yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=names)

    return d.mapInArrow(run, f"`{d.columns[0]}` {d.schema[0].dataType.simpleString()}, {made}")


def pack_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 180, tokens: int = 500) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk_text): no shuffle; a document is packed where it is read."""

    return chunk_rows(docs.select(key, text), lambda k, t: ((k, i, len(c), x) for c in [pack(t, size, overlap, tokens)] for i, x in enumerate(c)), "chunk_index int, total_chunks int, chunk_text string")


def trimmed_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is not blank, trimmed, with its place from 0."""
    return docs.select(key, F.posexplode(trimmed_parts(F.split(F.col(text), PARAGRAPH, -1))).alias("paragraph_index", "paragraph"))


def split_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part; parts begin where a sheet or a line of a table does."""
    return docs.select(key, F.posexplode(trimmed_parts(F.split(F.col(text), TABLE, -1))).alias("part_index", "part"))


def split_code(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_code: bool = False) -> DataFrame:
    """One row per segment, with whether it is code (fenced or inline)."""
    between, code = F.split(F.col(text), CODE, -1), F.regexp_extract_all(F.col(text), F.lit(CODE), F.lit(1))
    d = docs.select(key, between.alias("_b"), code.alias("_c"))
    segment = lambda is_code, x: F.struct(F.lit(is_code).alias("is_code"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("segment"))
    in_turn = F.flatten(F.transform(F.arrays_zip("_b", "_c"), lambda x: F.array(segment(False, x._b), segment(True, x._c))))
    d = d.select(key, F.posexplode(F.filter(in_turn, lambda x: x.segment != "")).alias("segment_index", "_s")).select(key, "segment_index", "_s.is_code", "_s.segment")
    return d.where("not is_code") if drop_code else d


def adaptive(text: str | None, profile: str, size: int, overlap: int, tokens: int) -> list[str]:
    """Tables part by part, code apart from what is around it, other texts as they are; equal chunks once."""
    t = (text or "").strip()
    if profile == "table_heavy":
        parts = re.split(TABLE, t)
    elif profile == "code_mixed":
        parts = re.split(CODE, t)
    else:
        parts = [t]
    whole = re.compile(CODE)
    made = [c for p in map(str.strip, parts) if p for c in ([p] if profile == "code_mixed" and whole.fullmatch(p) else pack(p, size, overlap, tokens))]
    return list(dict.fromkeys(made))


def adaptive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, profile, chunk_index, total_chunks, chunk_text) of rows with profile, size, overlap and tokens."""

    def rows(k, t, p, *how):
        return ((k, p, i, len(c), x) for c in [adaptive(t, p, *how)] for i, x in enumerate(c))

    return chunk_rows(docs.select(key, text, "profile", "size", "overlap", "tokens"), rows, "profile string, chunk_index int, total_chunks int, chunk_text string")


def pieces_of(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    """The text cut at the coarsest separator that it has, and what is still too long at finer ones."""
    if len(text) <= size:
        yield text
        return
    at = next((i for i, s in enumerate(separators) if s and s in text), None)
    if at is None:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    parts = text.split(separators[at])
    for p in [*(x + separators[at] for x in parts[:-1]), parts[-1]]:
        yield from pieces_of(p, size, separators[at + 1 :])


def recursive(text: str | None, size: int, overlap: int) -> list[str]:
    """Pieces joined up to `size`; a chunk begins with the last pieces of the one before, `overlap` characters at most."""
    chunks, held, n = [], [], 0
    for p in pieces_of(text or "", size, SEPARATORS):
        if held and n + len(p) > size:
            chunks.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    return [c for c in map(str.strip, [*chunks, "".join(held)]) if c]


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """(key, chunk_index, chunk_text)."""

    return chunk_rows(docs.select(key, text), lambda k, t: ((k, i, x) for i, x in enumerate(recursive(t, size, overlap))), "chunk_index int, chunk_text string")


def dedupe_chunks(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """The first of equal trimmed texts of each document."""
    return chunks.groupBy(key, F.regexp_replace(text, r"^\s+|\s+$", "").alias(text)).agg(F.min(index).alias(index))


def with_totals(chunks: DataFrame, key: str) -> DataFrame:
    """Adds how many chunks the document has."""
    return chunks.join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks")), key)


def chunk_metadata(chunks: DataFrame, docs: DataFrame, key: str, kept: list[str], models: dict[str, str]) -> DataFrame:
    """Chunks with how many their document has, the columns `kept` of the document, and the names of the models that their
    vectors are made with (column -> name). Documents have different keys."""
    d = with_totals(chunks, key).join(docs.select(key, *kept), key)
    return d.withColumns({column: F.lit(name) for column, name in models.items()})
