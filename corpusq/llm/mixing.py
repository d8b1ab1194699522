"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' values alone: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Sources in code-point order, null last, get the weights in turn. The targets add up to all sizes; none is
    above `cap` times its source's size. With the sources in order of the weight at which each one fills up,
    those before the first that stays below its limit are full, and the rest share what is left by weight.
    The table has one row a source, so its windows need no key.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    fills = Window.orderBy(F.col("limit") / F.col("w"), F.col(source).isNull(), F.col(source))
    before, whole = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_left"))
    )
    # the level rises with every source that fills up and falls after that, so the largest is the one that holds
    level = F.coalesce(F.max("level").over(whole), F.lit(0.0))
    return t.withColumn("target", F.least(F.col("limit"), level * F.col("w"))).select(source, "source_size", "target")


def numbered(own: DataFrame, odd: DataFrame) -> DataFrame:
    """`own` with _k: 1, 2, 3, ... for the rows that agree in source, id, size and weight, of ids in `odd`; null for others.
    Such rows are alike, so it does not matter which gets which. They are counted in the parts of a written copy, and
    each part goes on from the sum of those before."""
    own = written(own.withColumn("_part", F.spark_partition_id()), "mix-parts")
    own = own.join(odd, F.col("_id").eqNullSafe(F.col("_o")), "left").drop("_o")
    alike = ["_s", "_id", "_n", "_w"]
    counts = own.where("_odd").groupBy(*alike, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*alike).orderBy("_part")) - F.col("_c"))
    before = before.select(*[F.col(c).alias(f"_b{c}") for c in (*alike, "_part")], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in (*alike, "_part")]
    mine = own.where("_odd").join(before, same).drop(*[f"_b{c}" for c in (*alike, "_part")])
    mine = mine.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(*alike, "_part").orderBy("_n")))
    return mine.drop("_before", "_odd", "_part").unionByName(own.where("_odd is null").withColumn("_k", F.lit(None).cast("long")).drop("_odd", "_part"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0, bins: int = 4096, keep: bool = False, weight: str | None = None) -> DataFrame:
    """How often each document goes into a mix with the given weights of sources.

    Returns id, source, size, source_size, target, copies (whole copies of the document) and taken (their words);
    with `keep` also _row, the document's columns.

    A source whose target is r times its size takes floor(r) copies of every document for certain. What is left, one
    more copy with a mean chance of p = r - floor(r), is drawn in Pareto order: documents rank by their random odds
    u / (1 - u) over their inclusion odds p_i / (1 - p_i), and the first that fill the words left are taken. Documents of
    greater weight, or of greater size where there is no `weight` column, have a better chance: with the share
    h = w / (w + mean w) of each and its mean over the source's words H, p_i = p + min(p, 1 - p) * (h - H) / 2, so that
    the expected words are those of the target. As the size is fixed in words, the one document whose size comes nearest
    to the words that remain is added.

    No source is sorted as a whole: ranks are binned, bins are summed, and only the bin in which the target is
    reached is put in order. u is a hash of id and size, so reruns agree; where ids are null or repeated, rows that
    are alike are numbered, and the number is hashed as well.

    Null or wordless texts have size 0 and are not taken; null or negative weights count as 0. Null sources are a source
    of their own. Rows are kept as they are, repeated ones included. Very long texts are counted whole. Other columns,
    whatever their names, are not read (with `keep` they are kept in _row). An empty table gives an empty table.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    heavy = size.cast("double") if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_s"), size.alias("_n"), heavy.alias("_w"), *([F.struct(*docs.columns).alias("_row")] if keep else []))
    own = own if keep else written(own, "mix-sizes")  # texts are read once
    odd = own.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_id").isNull() | (F.col("_c") > 1)).select(F.col("_id").alias("_o"), F.lit(True).alias("_odd"))
    key = [F.col("_id"), F.col("_n")]
    if not odd.isEmpty():
        own = numbered(own, odd)
        key = [*key, F.col("_k")]
    u = unit_hash(*key[:2], seed=seed)
    own = own.withColumn("_u", u if len(key) == 2 else F.when(F.col("_k").isNull(), u).otherwise(unit_hash(*key, seed=seed))).drop("_k")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    totals = own.groupBy("_s").agg(F.sum("_n").alias("source_size"), F.avg("_w").alias("_mean"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    totals = written(totals, "mix-totals")  # a row a source
    share = lambda: F.when(F.col("_w") > 0, F.col("_w") / (F.col("_w") + F.col("_mean"))).otherwise(0.0)
    shares = own.join(totals.select(F.col("_s").alias("_t"), "_mean", "source_size"), same("_s", "_t")).groupBy("_s").agg((F.sum(F.col("_n") * share()) / F.nullif(F.first("source_size"), F.lit(0))).alias("_share"))
    t = source_targets(totals.select("_s", "source_size"), "_s", weights, cap).withColumnRenamed("_s", "_t").withColumn("_rate", rate)
    more = totals.join(shares.withColumnRenamed("_s", "_e"), same("_s", "_e")).select(F.col("_s").alias("_e"), "_mean", F.coalesce("_share", F.lit(0.0)).alias("_share"))
    t = t.join(more, same("_t", "_e")).drop("_e").withColumn("_whole", F.floor("_rate").cast("long")).withColumn("_p", F.col("_rate") - F.floor("_rate")).withColumn("_rest", F.col("_p") * F.col("source_size")).drop("_rate")
    d = own.join(written(t, "mix-targets"), same("_s", "_t")).drop("_t")
    d = d.withColumn("_p", F.col("_p") + F.least(F.col("_p"), 1 - F.col("_p")) * (share() - F.col("_share")) / 2)
    # odds q in (0, inf) of u over those of p; q / (1 + q) ranks alike and lies in (0, 1)
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    d = d.withColumn("_q", F.when(F.col("_p") > 0, q / (1 + q)).otherwise(1.0)).withColumn("_bin", F.least(F.floor(F.col("_q") * bins), F.lit(bins - 1)).cast("int"))
    in_bins = d.groupBy("_s", "_bin").agg(F.sum("_n").alias("_in"), F.first("_rest").alias("_rest"))
    edge = (
        in_bins.withColumn("_upto", F.sum("_in").over(Window.partitionBy("_s").orderBy("_bin")))
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy("_s")
        .agg(F.min("_bin").alias("_edge"), F.min_by(F.col("_upto") - F.col("_in"), "_bin").alias("_before"))
    )
    d = d.join(written(edge.withColumnRenamed("_s", "_e"), "mix-edges"), same("_s", "_e"), "left").drop("_e")
    rank = F.struct("_q", "_id", "_n")
    within = d.drop("_row").where(F.col("_bin") == F.col("_edge"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_q", "_id", "_n")) + F.col("_before")  # with all rows of equal rank
    cut = (
        within.withColumn("_upto", upto)
        .groupBy("_s", "_rest", "_before")
        .agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), rank)).alias("_last"), F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_upto"))).alias("_got"))
        .select(F.col("_s").alias("_c"), "_last", (F.col("_rest") - F.coalesce("_got", "_before")).alias("_gap"))
    )
    d = d.join(written(cut, "mix-cuts"), same("_s", "_c"), "left").drop("_c")
    drawn = (F.col("_p") > 0) & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & F.coalesce(rank <= F.col("_last"), F.lit(False))))
    d = d.withColumn("_drawn", drawn)
    spare = d.drop("_row").where(~F.col("_drawn") & (F.col("_p") > 0) & (F.col("_n") > 0) & (F.col("_n") < 2 * F.col("_gap")))
    off = F.abs(F.col("_all") - F.col("_gap"))
    nearest = (
        spare.groupBy("_s", "_gap", "_q", "_id", "_n")
        .agg(F.sum("_n").alias("_all"))
        .where(off < F.col("_gap"))
        .groupBy("_s")
        .agg(F.min(F.struct(off.alias("off"), "_q", "_id", "_n")).alias("_best"))
        .select(F.col("_s").alias("_c"), F.struct("_best._q", "_best._id", "_best._n").alias("_best"))
    )
    d = d.join(written(nearest, "mix-nearest"), same("_s", "_c"), "left").drop("_c")
    fills = ~F.col("_drawn") & F.coalesce(F.col("_best") == rank, F.lit(False))
    copies = F.when(F.col("_n") > 0, F.col("_whole") + F.col("_drawn").cast("long") + fills.cast("long")).otherwise(F.lit(0).cast("long"))
    rows = [F.col("_row")] if keep else []
    return d.select(F.col("_id").alias(doc_id), F.col("_s").alias(source), F.col("_n").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("_n") * copies).alias("taken"), *rows)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each document as many times as `mix` takes it, in the columns of `docs`."""
    m = mix(docs, doc_id, text, source, keep=True, **how)
    return m.where(F.col("copies") > 0).select(F.explode(F.array_repeat(F.col("_row"), F.col("copies").cast("int"))).alias("_row")).select("_row.*")
