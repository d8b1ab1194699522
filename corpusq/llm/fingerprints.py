"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

SAMPLES, SHINGLE = 64, 5
#: Samples in one aggregate: with more, the code generated for it is too long to be compiled by the JVM.
BLOCK = 16
#: Rows that stand in one stretch of the order of ids, and stretches at most; see `stretches`.
ROWS, STRETCHES = 1000, 1 << 16
TWO64 = float(1 << 64)


def with_shingles(df: DataFrame, text: str, to: str, size: int) -> DataFrame:
    """Adds the hashes of the runs of `size` words of a text, sorted; of fewer words, one of them all; none without
    words. Each step is a column of its own: inside a lambda an expression would be worked out for each element."""
    d = df.withColumn("__words", words(text)).withColumn("__hashed", F.transform("__words", lambda x: F.xxhash64(x))).drop("__words")
    n = F.size("__hashed")
    starts = F.when(n > size, F.sequence(F.lit(0), n - size)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("__hashed"), i + j) for j in range(size)]))
    return d.withColumn(to, F.sort_array(runs)).drop("__hashed")


def with_weights(df: DataFrame, hashes: str, to: str) -> DataFrame:
    """From a sorted array: (term, weight), the weight being how often the term stands there."""
    s = F.col(hashes)
    kind = "array<struct<term:bigint,weight:double>>"
    several = F.size(F.array_distinct(s)) < F.size(s)
    last = F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i + 1), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    d = df.withColumn("__last", F.when(several, last))
    runs = F.transform("__last", lambda e, k: F.struct(F.get(s, e).alias("term"), (e - F.when(k > 0, F.get(F.col("__last"), k - 1)).otherwise(F.lit(-1))).cast("double").alias("weight")))
    ones = F.transform(s, lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("weight")))
    return d.withColumn(to, F.when(F.col("__last").isNotNull(), runs).otherwise(ones).cast(kind)).drop("__last")


def exponential(h: Column) -> Column:
    """A standard exponential from a 64-bit hash; the greater the hash, the smaller."""
    return -F.log1p(-(F.lit(TWO64 / 2) - F.lit(0.5) - h) / F.lit(TWO64))


def with_samples(rows: DataFrame, samples: int) -> DataFrame:
    """(term, weight) rows -> with _b, _k and _v: terms of weight 1 stand once for each block _b of samples, with _k = -1;
    others once for each sample _k, with what it keeps of them in _v: a long that is the greater, the smaller the
    term's value a is.

    Consistent weighted sampling has r and c from Gamma(2, 1), b uniform, t = floor(ln w / r + b) and
    ln a = ln c - r (t - b + 1); the smallest a wins, and (term, t) is the sample. A Gamma(2, 1) is a sum of two
    standard exponentials, of which each is a uniform share. With four of them, c = x + x', exp(-z) = x / c and
    r = y + z, b = y / r, the distribution of (r, b, c) is the same, z being independent of c, and
    ln a = ln x - r t. For weight 1, t is 0 and a is x: the order of the hash behind x is all that is needed, and that
    hash stands for the sample. The same holds wherever t is 0.
    """
    several = F.when(F.col("weight") > 1.0, F.array(*[F.lit(k) for k in range(samples)])).otherwise(F.array(*[F.lit(-1 - b) for b in range(-(-samples // BLOCK))]))
    d = rows.withColumn("_m", F.explode(several))
    once = F.col("_m") < 0
    d = d.withColumn("_b", F.when(once, -1 - F.col("_m")).otherwise(F.floor(F.col("_m") / BLOCK).cast("int"))).withColumn("_k", F.when(F.col("term").isNotNull(), F.when(once, -1).otherwise(F.col("_m")))).drop("_m")
    for j in range(3):
        d = d.withColumn(f"_h{j}", F.when(F.col("_k") >= 0, F.xxhash64("term", 3 * F.col("_k") + j)))
    for j, name in enumerate(("_x", "_other", "_y")):
        d = d.withColumn(name, exponential(F.col(f"_h{j}")))
    d = d.withColumn("_r", F.col("_y") + F.log1p(F.col("_other") / F.col("_x")))
    d = d.withColumn("_t", F.floor((F.log("weight") + F.col("_y")) / F.col("_r")))
    moved = (F.lit(TWO64 / 2) + F.expm1(-F.col("_x") * F.exp(-F.col("_r") * F.col("_t"))) * F.lit(TWO64)).cast("long")
    return d.withColumn("_v", F.when(F.col("_t") == 0, F.col("_h0")).otherwise(moved)).drop("_h0", "_h1", "_h2", "_x", "_other", "_y", "_r", "_t")


def stretches(rows: DataFrame) -> tuple[Column, Column, int]:
    """(number of each row's stretch, whether the row is the first of its stretch, how many there are) of the
    ascending order of `_id`, null last, then `_h`.

    A stretch holds about ROWS rows; rows of equal id are in one. The driver holds the first id of each, STRETCHES
    numbers at most; those of rows without an id are told by the hash of their texts.
    """
    n, none = rows.agg(F.count("_id"), F.count(F.lit(1)) - F.count("_id")).first()
    parts = lambda k: int(max(1, min(STRETCHES, -(-k // ROWS))))
    kind = rows.schema["_id"].dataType.simpleString()
    ids = rows.where(F.col("_id").isNotNull()).select("_id").repartitionByRange(parts(n), "_id") if n else rows.select("_id").limit(0)
    firsts = sorted(r[0] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("_id").alias("f")).select("f").collect())
    width = F.lit(float(parts(none)))
    by_hash = F.floor((F.col("_h") / F.lit(TWO64) + F.lit(0.5)) * width)
    hashes = sorted(r[0] for r in rows.where(F.col("_id").isNull()).groupBy(by_hash.alias("p")).agg(F.min("_h").alias("f")).select("f").collect()) if none else []

    def place(x: Column, of: Column, size: int) -> Column:
        """How many of the sorted values are not above x: a binary search."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, size.bit_length())))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= size) & (F.get(of, at + step - 1) <= x), at + step).otherwise(at))

    text = [x if isinstance(x, (int, str)) else str(x) for x in firsts]
    ids_at, hashes_at = (F.from_json(F.lit(json.dumps(v)), f"array<{k}>") for v, k in ((text, kind), (hashes, "bigint")))
    by_id, by_h = place(F.col("_id"), ids_at, len(firsts)), place(F.col("_h"), hashes_at, len(hashes))
    part = F.when(F.col("_id").isNotNull(), F.greatest(by_id - 1, F.lit(0))).otherwise(F.greatest(by_h - 1, F.lit(0)) + len(firsts))
    first = F.when(F.col("_id").isNotNull(), F.coalesce(F.get(ids_at, by_id - 1) == F.col("_id"), F.lit(False))).otherwise(F.coalesce(F.get(hashes_at, by_h - 1) == F.col("_h"), F.lit(False)))
    return part, first, len(firsts) + len(hashes)


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_part, _seq (the row's place there), _id, _copy, _text and _edited: the text's first half, then as many code
    points of the next document.

    Texts are shuffled once, by stretch. The first rows of a stretch are also given to the one before (those of the
    first to the last), as _copy rows that come after all others there, so each row finds its next beside it.
    """
    t = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    part, first, n = stretches(t)
    before = F.when(F.col("_at") == 0, F.lit(max(n - 1, 0))).otherwise(F.col("_at") - 1)
    d = t.withColumn("_at", part.cast("int")).withColumn("_first", first)
    d = d.withColumn("_to", F.explode(F.when(F.col("_first"), F.array(F.struct(F.col("_at").alias("part"), F.lit(False).alias("copy")), F.struct(before.cast("int").alias("part"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_at").alias("part"), F.lit(False).alias("copy"))))))
    d = d.select(F.col("_to.part").alias("_part"), F.col("_to.copy").alias("_copy"), "_id", "_h", "_text")
    order = Window.partitionBy("_part").orderBy("_copy", F.col("_id").asc_nulls_last(), "_h")
    d = d.withColumn("_next", F.lead("_text").over(order)).withColumn("_seq", F.row_number().over(order))
    n_chars = F.length("_text")
    half = F.floor(n_chars / 2).cast("int")
    new = F.concat(F.col("_text").substr(F.lit(1), n_chars - half), F.coalesce(F.col("_next").substr(F.lit(1), half), F.lit("")))
    return d.select("_part", "_seq", "_copy", "_id", "_text", new.alias("_edited"))


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, size: int = SHINGLE) -> DataFrame:
    """keys -> with _sig, an array of `samples` longs, null for a text without terms. Terms are runs of `size` words,
    weighted by how often they stand in the text. Rows of equal keys count as one text."""
    d = with_weights(with_shingles(texts.select(*keys, F.col(text).alias("__text")), "__text", "_s", size), "_s", "_w")
    d = d.select(*keys, F.explode_outer("_w").alias("_t")).select(*keys, "_t.term", "_t.weight")
    d = with_samples(d, samples)
    first = F.col("_b") * BLOCK
    value = lambda j: F.when(F.col("_k") < 0, F.xxhash64("term", 3 * (first + j))).when(F.col("_k") == first + j, F.col("_v"))
    least = d.groupBy(*keys, "_b").agg(*[F.max(value(j)).alias(f"_s{j}") for j in range(BLOCK)])
    least = least.select(*keys, "_b", F.array(*[f"_s{j}" for j in range(BLOCK)]).alias("_part_sig"))
    blocks = [F.max(F.when(F.col("_b") == b, F.col("_part_sig"))) for b in range(-(-samples // BLOCK))]
    return least.groupBy(*keys).agg(F.slice(F.flatten(F.array(*blocks)), 1, samples).alias("_sig"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples on which two signatures agree; 1 for two of no terms, 0 if one has terms."""
    empty = lambda s: F.forall(s, lambda x: x.isNull())
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x) / F.size(a)
    return F.when(empty(a) & empty(b), 1.0).otherwise(same.cast("double"))


def as_text(signature: Column) -> Column:
    """Eight hex digits a sample; zeros for none."""
    digits = lambda x: F.lower(F.lpad(F.hex(F.coalesce(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))), 8, "0"))
    return F.array_join(F.transform(signature, lambda x: F.when(x.isNull(), F.lit("00000000")).otherwise(digits(x))), "")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row and of its edited text, and how like they are.

    The chance that two fingerprints agree on a sample is the generalised Jaccard similarity of the weighted
    shingles. Texts are shuffled once, by stretches of the order of ids; all that follows needs no other exchange.

    One row per row of `docs`, in the order of id (null last) and of a hash of the text, which says what is next; rows
    equal in both are alike. Null text: empty. Empty and wordless texts have no terms: their fingerprint is all
    zeros, like only that of another such text. Very long texts are taken whole. A document alone is its own next.
    Other columns, whatever their names, are not read. Empty table: empty result.
    """
    d = edited(docs, doc_id, text)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("text")))
    row = ["_part", "_seq", "_copy", "_id", "_n", "_sha"]
    own = d.select("_part", "_seq", "_copy", "_id", F.length("_text").cast("long").alias("_n"), F.unhex(F.sha2("_edited", 256)).alias("_sha"), F.explode(sides).alias("_side"))
    s = signatures(own.select(*row, "_side.side", "_side.text"), [*row, "side"], "text", samples, size)
    pair = s.groupBy(*row).agg(F.max(F.when(F.col("side") == 0, F.col("_sig"))).alias("_sig"), F.max(F.when(F.col("side") == 1, F.col("_sig"))).alias("_sig_edited"))
    pair = pair.withColumn("_sig_next", F.lead("_sig").over(Window.partitionBy("_part").orderBy("_seq"))).where(~F.col("_copy"))
    return pair.select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), as_text(F.col("_sig")).alias("fingerprint"), as_text(F.col("_sig_edited")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_sig_edited")).alias("near_edited"), likeness(F.col("_sig"), F.col("_sig_next")).alias("near_next"),
    )
