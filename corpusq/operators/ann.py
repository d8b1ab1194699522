"""Approximate nearest neighbours by an inverted file: vectors in cells, a few cells probed per query, exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusq.operators import topk
from corpusq.operators.retrieval import of_dims, top
from corpusq.shared import written

#: Vectors that the cells are fitted on at most, and of them those that the number of probes is set by.
SAMPLE, TRIALS = 65_536, 512
#: Cells at most, and rounds of the fit.
CELLS, ROUNDS = 4096, 10


@dataclass
class Index:
    """Where the vectors stand (path/vectors, by cell, with that schema), the cells' centres, and the cells probed for a query."""

    path: str
    schema: str
    centres: np.ndarray
    probes: int


def nearest_cells(unit: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first."""
    out = np.empty((len(unit), n), np.int32)
    for a in range(0, len(unit), 4096):
        s = unit[a : a + 4096] @ centres.T
        few = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(s), 1))
        out[a : a + 4096] = np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, 1), axis=1, kind="stable"), 1)
    return out


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of a spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n > 0, sums / np.where(n > 0, n, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells in which the trial vectors find that share of their k nearest of the sample. A vector of
    the sample is closer to the centres that were fitted on it than others are, so the share asked for has a margin."""
    trial = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    near = np.argsort(-(trial @ sample.T), axis=1, kind="stable")[:, : k + 1]
    own, order = nearest_cells(sample, centres, 1)[:, 0], nearest_cells(trial, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres), dtype=np.int32)[None, :].repeat(len(trial), 0), 1)
    needed = np.take_along_axis(place, own[near], 1)
    return next((p for p in range(1, len(centres) + 1) if (needed < p).mean() >= recall), len(centres))


def build(corpus: DataFrame, path: str, k: int = 10, recall: float = 0.95, cells: int | None = None) -> Index:
    """An index of (chunk_id, v) at `path`: all vectors, those with and those without many neighbours.

    Cells are fitted on the SAMPLE vectors whose ids hash lowest; there are about as many as the root of the number of
    vectors, CELLS at most. How many are probed is set by trials on that sample: few where the vectors stand in
    clusters, many where they fill the space. Null vectors and those without length are not indexed. All vectors must
    have the same number of dimensions.
    """
    c = corpus.select("chunk_id", "v").where("v is not null")
    n, least, most = c.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} dimensions")
    rows = c.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    sample = topk.unit(topk.matrix(rows["v"].combine_chunks()))
    sample = sample[~np.isnan(sample).any(axis=1)]
    cells = min(cells or round(n**0.5), CELLS, max(1, len(sample) // 4)) if len(sample) else 0
    centres = fitted(sample, cells) if cells else np.zeros((0, most or 1))
    assigned = written(in_cells(c, centres, 1), "cells").withColumnRenamed("_key", "chunk_id")
    # blocks keep a large cell from being one task
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / topk.CHUNKS).alias("blocks"), F.count(F.lit(1)).alias("n"))
    sizes.write.parquet(f"{path}/sizes")
    sizes = sizes_of(c.sparkSession, path)
    placed = assigned.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).alias("block"), "chunk_id", "v")  # a row a cell
    placed.repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/vectors")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select("block", "chunk_id", "v", "cell").schema)
    return Index(path, schema, centres, probes_for(sample, centres, k, recall) if cells else 0)


def sizes_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cell int, blocks long, n long").parquet(f"{path}/sizes")


def in_cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(key, v) -> cell, _key, v for the n nearest cells; vectors without length are left out."""
    key, shared = vectors.columns[0], vectors.sparkSession.sparkContext.broadcast(centres)  # CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(shared.value):
                continue
            u = topk.unit(topk.matrix(b.column(1)))
            good = np.flatnonzero(~np.isnan(u).any(axis=1))
            rows = b.take(pa.array(np.repeat(good, n)))
            yield pa.record_batch([pa.array(nearest_cells(u[good], shared.value, n).ravel()), rows.column(0), rows.column(1)], names=["cell", "_key", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"cell int, _key {kinds[key]}, v {kinds['v']}")


def probed(queries: DataFrame, index: Index, probes: int | None = None) -> DataFrame:
    """cell, query_id, v of the cells probed for each query."""
    q = of_dims(queries.select("query_id", "v"), index.centres.shape[1])
    return in_cells(q, index.centres, min(probes or index.probes, len(index.centres))).withColumnRenamed("_key", "query_id")


def candidates(queries: DataFrame, index: Index, probes: int | None = None) -> int:
    """How many pairs of a query and a vector are scored."""
    sizes = sizes_of(queries.sparkSession, index.path)
    return probed(queries, index, probes).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0] or 0  # a row a cell


def ann_topk(queries: DataFrame, index: Index, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, v) -> nearly the k nearest by cosine of the vectors in the index, with their exact scores.

    A query meets the vectors of the cells probed for it. Blocks of a cell's vectors meet blocks of its queries, each pair
    in a group of its own, so neither a large cell nor a cell that all queries probe is one task.
    """
    spark: SparkSession = queries.sparkSession
    q, sizes = written(probed(queries, index, probes), "probes"), sizes_of(spark, index.path)
    asked = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / topk.QUERIES).alias("asked"))
    each = written(sizes.join(asked, "cell").select("cell", "blocks", "asked"), "probed-cells")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(F.broadcast(each), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("asked"))).withColumn("block", upto("blocks"))  # a row a cell
    right = spark.read.schema(index.schema).parquet(f"{index.path}/vectors").join(F.broadcast(each), "cell").withColumn("part", upto("asked"))
    kind = to_arrow_type(right.schema["chunk_id"].dataType)
    keys = ["cell", "block", "part"]
    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {right.schema['chunk_id'].dataType.simpleString()}, score double"
    return top(topk.grouped(left.select(*keys, "query_id", "v"), right.select(*keys, "chunk_id", "v"), keys, lambda t: topk.Dense(t, kind, k), out), k)
