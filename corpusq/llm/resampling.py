"""Target-distribution importance resampling by hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What stands between words once A-Z are in lower case: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, NGRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bytes of texts that are split into words at once; a longer text is split alone.
SLICE = 8 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in their order, in stretches of about SLICE bytes."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield texts.slice(a, b - a)
        a = b


def buckets_of(texts: pa.Array, n_max: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each distinct feature, distinct feature of each feature, text of each feature, words of each text).

    Features are the runs of 1 to `n_max` words joined by one space. Words are dictionary-encoded; a run of n words is
    the pair of the run of n - 1 before it and one more index, so only distinct pairs are hashed, each from the hash
    of its first part.
    """
    low = pc.ascii_lower(texts).cast(pa.large_string())  # in this order: a cast slice begins elsewhere, which the kernel overlooks
    split = pc.split_pattern_regex(low, BETWEEN)
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
    flat = pc.list_flatten(split)
    filled = pc.greater(pc.binary_length(flat), 0)  # texts that begin or end between words give empty ones
    text = np.repeat(np.arange(len(texts)), sizes)[filled.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(flat.filter(filled))
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy().astype(np.int64)
    words = np.bincount(text, minlength=len(texts))
    crc = np.array([zlib.crc32(w) for w in names], np.int64)
    hashes, features, texts_of = [crc % buckets], [index], [text]
    run, at = index, np.arange(len(index))
    for n in range(2, n_max + 1):
        at = at[at + n - 1 < len(index)]
        at = at[text[at] == text[at + n - 1]]
        pair, own = np.unique(run[at] * len(names) + index[at + n - 1], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + names[x % len(names)], int(crc[x // len(names)])) for x in pair.tolist()], np.int64)
        run = np.zeros(len(index), np.int64)
        run[at] = own
        features.append(own + sum(map(len, hashes)))
        texts_of.append(text[at])
        hashes.append(crc % buckets)
    return np.concatenate(hashes), np.concatenate(features), np.concatenate(texts_of), words


def bucket_counts(docs: DataFrame, text: str, n_max: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                of, features, _, _ = buckets_of(part, n_max, buckets)
                total += np.bincount(of, np.bincount(features, minlength=len(of)), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the log of how much likelier a bucket is in the target than in the raw
    texts, one added to every count; floored. The table has as many rows as there are buckets, whatever the input."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    c = spark.range(buckets).withColumnRenamed("id", "bucket").join(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket", "left").fillna(0)
    c = c.crossJoin(F.broadcast(c.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    d = lambda x: F.col(x).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return c.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain_of: DataFrame, doc_id: str, text: str, n_max: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """_id, n_words, n_features and weight of each row: the floored mean of the gains of its features, 0 without any."""
    at, gain = np.zeros(buckets, np.int64), [(r.bucket, r.gain) for r in gain_of.collect()]  # a row a bucket
    for k, g in gain:
        at[k] = g
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = 0
            for part in slices(b.column(1)):
                of, features, text_of, words = buckets_of(part, n_max, buckets)
                order = np.argsort(text_of, kind="stable")
                own = pc.take(pa.array(shared.value), pa.array(of)).to_numpy()[features[order]]
                n = np.bincount(text_of, minlength=len(part))
                ends = np.cumsum(n)
                sums = np.zeros(len(part), np.int64)
                if len(own):
                    sums[n > 0] = np.add.reduceat(own, (ends - n)[n > 0])
                yield pa.record_batch([b.column(0).slice(begin, len(part)), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums // np.maximum(n, 1))], names=["_id", "n_words", "n_features", "weight"])
                begin += len(part)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(weigh, f"_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number that depends on seed and id alone, floored."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """`scored` (_id, score and others, a written table) with `rank`: of the N eligible rows the floor(percent * N / 100)
    highest scores get 1, 2, 3, ..., equal ones by id; the others null.

    Scores are whole numbers within the bounds of logs, so a table of how many rows have each of them is short
    whatever the input: it gives the lowest score drawn and the first rank of each. Only rows of the same score are put in
    order; ids spread over the scores by their Gumbel numbers, so none has more than a few in ten thousand.
    """
    counts = written(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    above = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"))
    take = counts.agg(F.expr(f"sum(n) * {percent} div 100").alias("take"))
    drawn = written(above.crossJoin(F.broadcast(take)).where("above < take").select("score", "above", "take"), "drawn-scores")  # take: one row
    rows = scored.withColumn("_in", eligible).crossJoin(F.broadcast(drawn.agg(F.min("score").alias("_cut"))))  # one row
    drawn_score = F.col("_in") & F.coalesce(F.col("score") >= F.col("_cut"), F.lit(False))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("_id").isNull(), "_id", "n_features", "n_words"))
    high = rows.where(drawn_score).join(drawn, "score").withColumn("rank", F.when(place <= F.col("take"), place).cast("long"))
    low = rows.where(~drawn_score).withColumn("rank", F.lit(None).cast("long"))
    return high.select(*scored.columns, "rank").unionByName(low.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n_max: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`: rows are drawn towards the texts of `target`.

    Features are runs of 1 to `n_max` words of whole texts (A-Z in lower case; digits, letters and all that is not ASCII
    make words), hashed by CRC-32 into `buckets`. A row's weight is the mean of its features' log ratios between
    target and `docs`; with a Gumbel number of its id on top, the highest scores are a draw without replacement in
    proportion to those ratios. Of rows with `least_words` words `percent` of a hundred are drawn and ranked.

    Counts are summed in the tasks; what is sent around has a row a bucket. Null or wordless texts: no features, weight 0,
    never drawn where `least_words` is above 0. Rows that share an id share the Gumbel number and are ranked one
    by one; null ids share one, and come last among ties. Very long texts are split whole. Other columns, whatever their
    names, are not read. Empty `docs`: empty result. Empty `target`: gains come from `docs` alone.
    """
    gain_of = gains(bucket_counts(docs, text, n_max, buckets), bucket_counts(target, target_text, n_max, buckets), buckets)
    d = weights(docs, gain_of, doc_id, text, n_max, buckets)
    d = written(d.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)), "scores")
    out = ranked(d, F.col("n_words") >= least_words, percent)
    return out.select(F.col("_id").alias(doc_id), "n_features", "weight", "score", "rank")
