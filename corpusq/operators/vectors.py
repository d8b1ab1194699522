"""Dense and sparse vectors of texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusq.functions.codes import sliced
from corpusq.shared import written

#: Words that are counted at once.
WORDS = 1 << 20
#: Terms of which the numbers are sent to every task; beyond them counts and numbers meet by a shuffle.
TERMS = 1_000_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of length 1; those within 0.01 of it, and those without length, stay as they are."""
    d = df.withColumn("_n", norm(F.col(vector)))
    off = (F.abs(F.col("_n") - 1) > 0.01) & (F.col("_n") >= 1e-10)
    return d.withColumn(vector, F.when(off, F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).otherwise(F.transform(vector, lambda x: x.cast("double")))).drop("_n")


def dimension_check(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of each number of dimensions, and whether it is the only one."""
    sizes = df.groupBy(F.size(vector).alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    kinds = sizes.agg(F.count(F.lit(1)).alias("_kinds"))
    return sizes.join(F.broadcast(kinds)).select("dims", "n", (F.col("_kinds") == 1).alias("all_same"))  # one row


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of hashed words, of length 1: the same for the same text everywhere, without a model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def embed_dense(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(key, vector) by the embedder, a batch of texts at a time; another number of vectors than texts is an error."""
    embed = embedder or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = embed([t or "" for t in b[text]])
            if len(made) != len(b):
                raise ValueError(f"{len(made)} vectors for {len(b)} texts")
            yield pd.DataFrame({key: b[key], "vector": [np.asarray(v, float).tolist() for v in made]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")


def with_dense(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray] | None = None, to: str = "dense") -> DataFrame:
    """The rows with the vector of their text; null text is an empty one."""
    embed = embedder or hashing_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = embed([t or "" for t in b.column(text).to_pylist()])
            if len(made) != b.num_rows:
                raise ValueError(f"{len(made)} vectors for {b.num_rows} texts")
            yield pa.record_batch([*b.columns, pa.array([np.asarray(v, float).tolist() for v in made], pa.list_(pa.float64()))], names=[*b.schema.names, to])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(to, ArrayType(DoubleType()))]))


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def counts_in_rows(words: pa.Array, index: Callable[[list[str]], np.ndarray] | None = None) -> pa.Array:
    """The different words of each row, in any order, with their numbers: lists of (term, n). With `index`, which gives
    whole numbers below 2^32 for words, lists of (i, n) by i; words of one index count together."""
    done = []
    for a, b in sliced(pc.list_value_length(words), WORDS):
        part = words.slice(a, b - a)
        coded = part.flatten().dictionary_encode()
        code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        if index:
            code, size = index(coded.dictionary.to_pylist())[code], 1 << 32
        row = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
        pair, n = np.unique(row * size + code, return_counts=True)
        term = pa.array(pair % size) if index else coded.dictionary.take(pa.array(pair % size))
        bounds = np.searchsorted(pair // size, np.arange(len(part) + 1))
        done.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([term, pa.array(n, pa.int64())], ["i" if index else "term", "n"])))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.struct([("i", pa.int64()) if index else ("term", pa.string()), ("n", pa.int64())])))


def term_indices(terms: list[str]) -> np.ndarray:
    """The places of terms among 2^32."""
    return np.fromiter((int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in terms), np.int64, len(terms))


def shared_keys(d: DataFrame) -> DataFrame:
    """The keys that several rows have; a table by itself, so that it is known to be small where it is."""
    return written(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows"), "shared-keys")


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join where null keys are alike too."""
    to = b.select(*[F.col(k).alias(f"_to_{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_to_{i}"))
    return a.join(to, on, how)


def encode_sparse(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, indices, values) of term counts, by index; null for texts without terms. Terms of one index count together.

    Terms are counted in the row that has them, and nothing is shuffled but the counts of rows that share a key."""
    count = F.arrow_udf(lambda w: counts_in_rows(w, term_indices), "array<struct<i: long, n: long>>").asNondeterministic()
    d = df.select(key, count(words_of(text)).alias("_p"))
    several = shared_keys(df.select(key))
    if not several.isEmpty():
        together = same(d, several, [key], "left_semi").select(key, F.explode_outer("_p").alias("_p")).groupBy(key, "_p.i").agg(F.sum("_p.n").alias("n"))
        together = together.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("_p"))
        d = same(d, several, [key], "left_anti").unionByName(together)
    have = F.size("_p") > 0
    return d.select(key, F.when(have, F.transform("_p", lambda x: x.i)).alias("indices"), F.when(have, F.transform("_p", lambda x: x.n)).alias("values"))


def with_sparse(df: DataFrame, text: str) -> DataFrame:
    """The rows with the sparse vector of their own text, `indices` and `values` as of `encode_sparse`, and the number of
    different `terms`, which is more than that of indices where terms share one."""

    def made(words: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.list_value_length(counts_in_rows(words)), counts_in_rows(words, term_indices)], ["terms", "pairs"])

    count = F.arrow_udf(made, "struct<terms: int, pairs: array<struct<i: long, n: long>>>").asNondeterministic()
    d = df.withColumn("_p", count(words_of(text)))
    part = lambda x: F.when(F.col("_p.terms") > 0, F.col(f"_p.pairs.{x}"))
    return d.withColumns({"indices": part("i"), "values": part("n"), "terms": F.col("_p.terms")}).drop("_p")


def bm25_weights(df: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, term, weight): term frequency with length norm, times inverse document frequency.

    Terms are counted in the row that has them. How many rows have a term is a table of the vocabulary: up to TERMS of them
    go to every task, and nothing but their partial counts is shuffled."""
    count = F.arrow_udf(lambda w: counts_in_rows(w), "array<struct<term: string, n: long>>").asNondeterministic()
    d = df.select(key, words_of(text).alias("_w")).select(key, F.size("_w").alias("_len"), "_w")
    rows = d.select(key, "_len", count(F.col("_w")).alias("_p"))
    all_ = d.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_len").alias("_mean"))
    tf = rows.select(key, "_len", F.inline("_p")).withColumnRenamed("n", "_tf")
    several = shared_keys(df.select(key))
    if not several.isEmpty():  # rows of one key and length count together
        together = same(tf, several, [key], "left_semi").groupBy(key, "_len", "term").agg(F.sum("_tf").alias("_tf"))
        tf = same(tf, several, [key], "left_anti").unionByName(together)
    df_ = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")), "document-counts")
    df_ = F.broadcast(df_) if df_.count() <= TERMS else df_
    j = tf.join(df_, "term").join(F.broadcast(all_))  # one row
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    return j.select(key, "term", (idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))).alias("weight"))


def model_mismatch(hits: DataFrame, model: str, wanted: str) -> DataFrame:
    """Hits by the model of their vectors, and whether it is another than the query's."""
    return hits.groupBy(model).agg(F.count(F.lit(1)).alias("n")).withColumn("mismatch", ~F.col(model).eqNullSafe(F.lit(wanted)))
