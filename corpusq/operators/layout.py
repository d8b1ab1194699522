"""Blocks of page layouts: kinds, reading order, text, summary. A block has doc_id, page, x0, y0, x1, y1, font (mean
size), text, page_width and page_height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words at the start of footers and headers, and limits of size and place.
FOOTER = r"(?i)^(page\s+\d+|©|\||-{5,}|\*{3,}|confidential|draft)"
HEADER = r"(?i)^(chapter\s+\d|section\s+\d|\.{2,})"
TITLE, HEADING, BOTTOM, TOP, INDENT = 18.0, 13.5, 0.92, 0.08, 0.05


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def is_noise(text: Column) -> Column:
    t = trimmed(text)
    return (F.length(t) < 3) | t.rlike(FOOTER) | t.rlike(HEADER)


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Adds `kind`, the first that fits."""
    t, c = trimmed(F.col("text")), F.col
    kind = (
        F.when(is_noise(c("text")), "noise").when(c("y1") / c("page_height") > BOTTOM, "footer").when(c("y0") / c("page_height") < TOP, "header")
        .when(c("font") >= TITLE, "title").when(c("font") >= HEADING, "heading").when(c("text").rlike(r"\|.*\|.*\|"), "table")
        .when(t.rlike(r"^([-*•]|\d+[.)])\s+"), "list_item").when(t.rlike("^[\"“”]"), "quote")
        .when((c("x0") > c("page_width") * INDENT) & c("text").rlike(r"[{}]|    "), "code").otherwise("paragraph")
    )
    return blocks.withColumn("kind", kind)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds `place`, from 0 on each page, from top to bottom and left to right; blocks at one point by their text."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "text")
    return blocks.withColumn("place", F.row_number().over(w) - 1)


def layout_to_text(blocks: DataFrame) -> DataFrame:
    """The text of each document in reading order, with marks for titles, headings and tables; without noise, footers
    and headers. `blocks` have kind and place."""
    kept = blocks.where(~F.col("kind").isin("noise", "footer", "header"))
    mark = F.when(F.col("kind") == "title", "\n## ").when(F.col("kind") == "heading", "\n### ").when(F.col("kind") == "table", "\n[TABLE]\n").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("page", "place", F.concat(mark, F.col("text"), F.lit("\n")).alias("t"))))
    d = kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.t), "\n").alias("text"))
    return d.withColumn("text", trimmed(F.col("text")))


def layout_summary(blocks: DataFrame) -> DataFrame:
    """Pages, blocks, and blocks of each kind, per document."""
    kinds = blocks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.collect_set("page").alias("_pages"))
    d = kinds.groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("pages"), F.sum("n").alias("blocks"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("_k"))
    return d.withColumn("kinds", F.map_from_entries("_k")).drop("_k")


def vertical_overlap(blocks: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Pairs of blocks of a page whose centres differ in height by less than the threshold. Blocks meet only in bands of
    that height: each is in its own and the next one's."""
    b = blocks.withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("band", F.floor(F.col("cy") / threshold))
    left = b.select("doc_id", "page", F.col("place").alias("a"), F.col("cy").alias("ya"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = b.select("doc_id", "page", F.col("place").alias("b"), F.col("cy").alias("yb"), "band")
    near = left.join(right, ["doc_id", "page", "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ya") - F.col("yb")) < threshold))
    return near.select("doc_id", "page", "a", "b")
