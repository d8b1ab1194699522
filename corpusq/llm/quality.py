"""Quality rules: counts over a text's words, and lines that recur across a host's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words, written

SYMBOLS = r"[#*$%&|<>]"
ADDED = frozenset("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed removed_words removed_lines kept".split())


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; null counts as empty.

    n_repeat_words: three-word windows are hashed to 64 bits; hashes that sort beside an equal one are found
    twice. Their positions come from a look-up where they are few, from a sort of (hash, position) where they
    are many; what they cover is the sum of the gaps between them, three at most.
    """
    own = set(df.columns)
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("__q_w", words(text)).withColumn("n_words", F.size("__q_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__q_w", "")).cast("long")).withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
    d = d.withColumn("__q_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
    at = lambda a, i: F.get(F.col(a), i)
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__q_h", F.transform(starts, lambda i: F.xxhash64(at("__q_w", i), at("__q_w", i + 1), at("__q_w", i + 2))))
    d = d.withColumn("__q_s", F.sort_array("__q_h"))
    d = d.withColumn("__q_twice", F.array_distinct(F.filter("__q_s", lambda x, i: (i > 0) & (x == at("__q_s", i - 1)))))
    few = F.size("__q_twice") <= 24
    d = d.withColumn("__q_pairs", F.when(few, F.lit(None)).otherwise(F.sort_array(F.transform("__q_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    looked_up = F.filter(F.transform("__q_h", lambda x, i: F.when(F.array_contains(F.col("__q_twice"), x), i)), lambda i: i.isNotNull())
    by_order = F.array_sort(F.transform(F.filter("__q_pairs", lambda p, k: (p.h == at("__q_pairs", k - 1).h) | (p.h == at("__q_pairs", k + 1).h)), lambda p: p.i))
    d = d.withColumn("__q_at", F.when(F.size("__q_twice") == 0, F.array().cast("array<int>")).when(few, looked_up).otherwise(by_order))
    covered = F.aggregate(F.transform("__q_at", lambda i, k: F.least(F.lit(3), F.coalesce(at("__q_at", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", covered.cast("long")).select(*[c for c in df.columns], *[c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if c not in own])


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, digits as 0, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"))


def line_rows(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per line with a word: id, host and the hash of the normalised line."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return df.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.explode(F.transform(lines, lambda x: F.xxhash64(normal_line(x)))).alias("_line"))


def common_lines(rows: DataFrame, host_docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Lines of a host in more documents, told apart by id, than both limits. Null ids count as one document."""
    per = rows.groupBy("_host", "_line", "_id").agg(F.lit(1).alias("_one")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > min_docs)
    limits = host_docs.select(F.col("_host").alias("_h"), (F.col("_all") * share).alias("_limit"))
    return per.join(limits, F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("_docs") > F.col("_limit")).select("_host", "_line", "_docs")


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 10,
    share: float = 0.02,
    max_removed: float = 0.5,
) -> DataFrame:
    """Base counts and the verdict of cross-document line frequency, one row per document.

    Lines are normalised and hashed; a line in more than `min_docs` documents and more than `share` of the
    documents of its host (null is a host too) is above the limit and goes. A document counts once for a line,
    however often it has it; copies under other ids are documents too. A document that loses more than
    `max_removed` of its words that way is depleted. kept is false for the depleted and for those that fail
    the base rules: fewer than `min_words` words, or more than `max_repeat_percent` % of words in repeated
    three-word windows. removed_lines holds the hashes of the lines that go from the document.

    Rows that share an id, or have none, count as one document for a line; each is judged by its own lines. Null or
    empty text: no words, base_failed. Very long texts are taken whole. Columns named like those that are added are
    replaced, others stay. Empty table: empty result.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED or c in (doc_id, text, host)])
    base = signals(docs, text)
    rows = line_rows(docs, doc_id, text, host)
    hosts = docs.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_all"))
    # a host has at most (lines of a document / share) common lines, however many documents it has
    common = common_lines(rows, hosts, min_docs, share).groupBy("_host").agg(F.collect_set("_line").alias("__common"))
    common = written(common.withColumnRenamed("_host", "__common_host"), "common-lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = base.withColumn("base_failed", failed).join(common, F.col(host).eqNullSafe(F.col("__common_host")), "left").drop("__common_host")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    d = d.withColumn("__gone", F.when(F.col("__common").isNotNull(), F.filter(hashed, lambda x: F.array_contains(F.col("__common"), x.h)))).drop("__common")
    d = d.withColumn("removed_words", F.coalesce(F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x.n), F.lit(0).cast("long")))
    d = d.withColumn("removed_lines", F.when(F.size("__gone") > 0, F.array_distinct(F.transform("__gone", lambda x: x.h)))).drop("__gone")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without the lines above the limits, in the columns of `docs`; n_chars, if there,
    follows the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # written with all counts: a filter, or counts that are not asked for, would repeat them inside each other
    d = written(quality_rules(rows, **limits).drop("doc_id", "text", "source"), "quality").where(F.col("kept"))
    own = F.col("__row").getField(text)
    left = F.filter(F.split(own, "\n", -1), lambda x: ~F.array_contains(F.col("removed_lines"), F.xxhash64(normal_line(x))))
    d = d.withColumn("__text", F.when(F.size("removed_lines") > 0, F.array_join(left, "\n")).otherwise(own)).select("__row.*", "__text")
    d = d.withColumn(text, F.col("__text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length(text).cast("long"))
    return d.select(*docs.columns)
