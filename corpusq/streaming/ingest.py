"""Arriving files into a chunk table, batch by batch, and reading that table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from corpusq.functions import text as quality
from corpusq.operators import chunking, vectors
from corpusq.shared import written
from corpusq.sources.snapshots import ChunkTable


def arriving(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """New files of a folder as a stream; a batch takes that many at most, so what it holds is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def scored_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", embedder: Callable | None = None) -> DataFrame:
    """Chunks of each document by its profile, with the document's quality score, and a dense and a sparse vector each.
    Documents of one call have different keys."""
    d = written(quality.chunk_params(quality.signals(docs, text)).select(key, text, "profile", "size", "overlap", "tokens", "quality_score"), "scored")
    c = chunking.adaptive_chunks(d, key, text).join(d.select(key, "quality_score"), key).withColumn("chunk_id", F.concat_ws("#", key, "chunk_index"))
    return vectors.with_dense(c, "chunk_text", embedder).join(vectors.encode_sparse(c, "chunk_id", "chunk_text"), "chunk_id")


#: Fixed value: chunks that are handed on at once; and bytes of them.
FLUSH_ROWS, FLUSH_BYTES = 5000, 8 << 20


def in_flushes(chunks: DataFrame, text: str, rows: int = FLUSH_ROWS, size: int = FLUSH_BYTES) -> DataFrame:
    """The chunks with `flush`: rows of one task in their order, at most `rows` of them and at most `size` bytes of text
    (or one row that alone has more). However large a file is, what is handed on at once is bounded; the last flush of
    a task holds what is left. Null text has no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, bytes_ = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            own = []
            for n in pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist():
                if held and (held >= rows or bytes_ + n > size):
                    number, held, bytes_ = number + 1, 0, 0
                held, bytes_ = held + 1, bytes_ + n
                own.append(f"{task}-{number}")
            yield pa.record_batch([*b.columns, pa.array(own, pa.string())], names=[*b.schema.names, "flush"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("flush", StringType())]))


def hand_on(chunks: DataFrame, text: str, sink: Callable[[list[dict]], None], rows: int = FLUSH_ROWS, size: int = FLUSH_BYTES) -> DataFrame:
    """Give the chunks to `sink` in their tasks, a flush at a time, and return (flush, rows) of what was given. A task that
    is run again gives its flushes again under the same names, so a sink that goes by keys takes nothing twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def given() -> pa.RecordBatch:
            sink(held)
            return pa.record_batch([pa.array([held[0]["flush"]]), pa.array([len(held)], pa.int64())], names=["flush", "rows"])

        for b in batches:
            for row in b.to_pylist():
                if held and row["flush"] != held[0]["flush"]:
                    yield given()
                    held = []
                held.append(row)
        if held:
            yield given()

    return in_flushes(chunks, text, rows, size).mapInArrow(run, "flush string, rows long")


def ingest_stream(docs: DataFrame, table: ChunkTable, checkpoint: str, text: str = "text", chunks: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start: the documents of each batch, in chunks (sentences, or what `chunks` makes of them), take the place of those
    that the table has of their keys; documents without chunks lose theirs. A batch that comes again after a failure is
    merged again with the same order, so nothing stands twice. The query ends when all that is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        made = written(chunks(batch) if chunks else chunking.sentences(batch, table.key, text), "batch")  # made once, used thrice
        table.merge(made, number, gone=batch.join(made.select(table.key).distinct(), table.key, "left_anti"))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream without those whose key came within `late` before; state is kept no longer than that."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
