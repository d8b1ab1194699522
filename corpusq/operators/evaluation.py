"""Latencies, status logs, ratings and context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import rounded, truncate


#: Groups up to so many rows are sorted whole; the accuracy of the ranges in which the values of larger ones are sought.
SMALL, ACCURACY = 100_000, 10_000


def in_ranges(v: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, _n, _j, _key, _c): for the j-th share how many rows have each value in the range that holds its place, and,
    with a null key, how many lie below. The range is that of two approximate percentiles, whose error is bounded."""
    off = 2 / ACCURACY
    ends = [x for p in shares for x in (max(0.0, p - off), min(1.0, p + off))]
    stats = v.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.percentile_approx(value, ends, ACCURACY).alias("_cuts"))
    whole = F.col("_n") <= SMALL
    low = lambda j, p: F.when(whole | F.lit(p <= off), F.col("_min")).otherwise(F.col("_cuts")[2 * j])
    high = lambda j, p: F.when(whole | F.lit(p + off >= 1), F.col("_max")).otherwise(F.col("_cuts")[2 * j + 1])
    ranges = F.array(*[F.struct(F.lit(j).alias("j"), low(j, p).alias("low"), high(j, p).alias("high")) for j, p in enumerate(shares)])
    stats = stats.select(F.col(group).alias("_g"), "_n", ranges.alias("_r"))
    d = v.join(stats, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_r", F.explode(F.filter("_r", lambda x: F.col(value) <= x.high)))
    return d.groupBy(group, "_n", F.col("_r.j").alias("_j"), F.when(F.col(value) >= F.col("_r.low"), F.col(value)).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))


def latency_percentiles(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The value at place floor(n * p) of each group in ascending order, exact; null values are left out.

    Of a large group only the values in a narrow range around each place are put in order, a few in ten thousand and
    counted before: what lies below is a count. So no task sorts a group.
    """
    v = in_ranges(df.where(F.col(value).isNotNull()).select(group, value), group, value, shares)
    order = Window.partitionBy(group, "_j").orderBy(F.col("_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("_upto", F.sum("_c").over(order))
    place = lambda p: F.floor(F.col("_n") * F.lit(p))
    at = [F.min(F.when((F.col("_j") == j) & (F.col("_upto") > place(p)), F.col("_key"))).alias(f"p{round(p * 100)}") for j, p in enumerate(shares)]
    return v.groupBy(group).agg(F.max("_n").alias("n"), *at)


def latest_status(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Later values overwrite earlier ones field by field; nulls overwrite nothing. One shuffle, combined before it."""
    return events.groupBy(key).agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])


def stage_durations(events: DataFrame, key: str, order: list[str], stage: str, ts: str = "ts") -> DataFrame:
    """Rows where the stage changes, with the seconds until the next change; null for the last."""
    w = Window.partitionBy(key).orderBy(*order)
    changes = events.withColumn("_was", F.lag(stage).over(w)).where(~F.col(stage).eqNullSafe(F.col("_was")) | F.col("_was").isNull())
    seconds = F.unix_seconds(F.lead(ts).over(w).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    return changes.select(key, *order, stage, seconds.alias("seconds"))


def feedback_summary(rated: DataFrame, group: str, rating: str) -> DataFrame:
    """Ratings of 1 (up) and 0 (down) per group; unrated rows count as neither."""
    return rated.groupBy(group).agg(F.count_if(F.col(rating) == 1).alias("up"), F.count_if(F.col(rating) == 0).alias("down"), F.count(F.lit(1)).alias("n"))


def build_context(hits: DataFrame, file: str = "file", text: str = "text", dataset: str = "dataset", split: str = "split", quality: str = "quality", profile: str = "profile") -> DataFrame:
    """(query_id, rank, text, and what there is of the other columns) -> one block per query: its sources in order of
    rank, each with its whole text. Dataset and split are unknown where null or no column; the other parts of the
    header are left out where null, no column, or (profile and file) empty."""
    none = F.lit(None).cast("string")
    at = lambda c: F.col(c).cast("string") if c in hits.columns else none
    filled = lambda c: F.when(at(c) != "", at(c))
    named = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    shown = F.format_string("%.3f", F.col(quality).cast("double")) if quality in hits.columns else none
    shown = F.when(F.col(quality).isNotNull(), shown) if quality in hits.columns else none
    parts = [named("Dataset", F.coalesce(at(dataset), F.lit("unknown"))), named("Split", F.coalesce(at(split), F.lit("unknown"))), named("Quality", shown), named("Profile", filled(profile)), named("File", filled(file))]
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | "), F.concat_ws(" | ", *parts), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(in_order, lambda x: x.b), "\n---\n").alias("context"))


def format_contexts(hits: DataFrame, text: str = "text", limit: int = 600) -> DataFrame:
    """(query_id, rank, text) -> one line "[i] text" per source for judge prompts, from 0 in order of rank, texts beyond
    `limit` characters cut with '...'."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", truncate(F.coalesce(F.col(text), F.lit("")), limit).alias("t"))))
    lines = F.transform(in_order, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x.t))
    return hits.groupBy("query_id").agg(F.array_join(lines, "\n").alias("contexts"))


def mean_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation without NaN, and how many values are NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(group).agg(rounded(F.avg(v), 4).alias("mean"), rounded(F.stddev_pop(v), 4).alias("std"), F.count_if(F.isnan(value)).alias("n_nan"))


#: The states of a job that do not change any more.
TERMINAL = ("completed", "failed", "cancelled")


def drop_terminal(status: DataFrame, state: str) -> DataFrame:
    return status.where(~F.coalesce(F.col(state).isin(*TERMINAL), F.lit(False)))


def progress_pct(done: Column, total: Column, embedding: bool = True, finished: Column | None = None) -> Column:
    """From 40 to 90 while embedding, from 0 to 100 over files; 99 at most until finished."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    pct = 40 + 50 * share if embedding else 100 * share
    return rounded(F.least(pct, F.lit(99.0)) if finished is None else F.when(finished, 100.0).otherwise(F.least(pct, F.lit(99.0))), 2)


def ingest_eta(status: DataFrame, now: Column) -> DataFrame:
    """(state, done, total, started) -> seconds to go at the rate so far; null where that cannot be told."""
    elapsed = F.unix_seconds(now) - F.unix_seconds("started")
    can = (F.col("state") == "running") & (F.col("done") > 0) & (elapsed > 0) & (F.col("total") >= F.col("done"))
    return status.withColumn("eta", F.when(can, F.floor((F.col("total") - F.col("done")) * elapsed / F.col("done")).cast("long")))


def assemble_tokens(events: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """JSON lines of each request -> its text from the chunks in order, its sources from the end, its error. Lines that are
    blank or no JSON are skipped."""
    e = events.withColumn("_e", F.from_json(line, "type string, content string, sources string, error string")).where("_e.type is not null")
    chunks = F.array_sort(F.collect_list(F.when(F.col("_e.type") == "chunk", F.struct(F.col(order).alias("o"), F.coalesce("_e.content", F.lit("")).alias("t")))))
    return e.groupBy(key).agg(F.array_join(F.transform(chunks, lambda x: x.t), "").alias("text"), F.max_by(F.when(F.col("_e.type") == "end", F.col("_e.sources")), F.when(F.col("_e.type") == "end", F.col(order))).alias("sources"), F.max(F.when(F.col("_e.type") == "error", F.col("_e.error"))).alias("error"))


def throughput(runs: DataFrame, batch: str, items: str, seconds: str) -> DataFrame:
    return runs.groupBy(batch).agg(F.sum(items).alias("items"), rounded(F.sum(items) / F.sum(seconds), 4).alias("per_second"))


def stream_run_summary(runs: DataFrame) -> DataFrame:
    """(ok, first_token, tokens, text, sources, score) of runs -> counts, latencies and means in one row."""
    text = F.coalesce("text", F.lit(""))
    return runs.agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), rounded(F.avg(F.when(F.col("ok"), F.col("first_token"))), 3).alias("first_token"), F.sum("tokens").alias("tokens"),
        F.sum(F.length(text)).alias("chars"), F.sum(F.regexp_count(text, F.lit(r"\S+"))).alias("words"), F.sum("sources").alias("sources"), rounded(F.avg("score"), 3).alias("score"),
    )


def load_qa_samples(rows: DataFrame, n: int, order: str) -> DataFrame:
    """(question, context, answers: a struct with an array of texts) -> the first n with all three, with the first answer."""
    d = rows.withColumn("answer", F.trim(F.get(F.col("answers.text"), 0)))
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("question", "context", "answer")]
    return d.where(filled[0] & filled[1] & filled[2]).orderBy(order).limit(n).drop("answers")
