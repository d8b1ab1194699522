"""Judge requests and replies, and tables of models and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import rounded

#: Names under which a reply may give its score, in order, and the metrics that are judged.
SCORE_KEYS = ("score", "rating", "faithfulness", "relevance", "precision", "result", "value", "groundedness")
METRICS = {
    "faithfulness": "Is every statement of the answer borne out by the contexts?",
    "answer_relevance": "Does the answer address the question?",
    "context_relevance": "Do the contexts bear on the question?",
    "context_precision": "How useful is each context for the question, by its number?",
    "groundedness": "Which share of the answer can be traced to the contexts?",
}


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def parse_score(reply: Column, loose: bool = False) -> Column:
    """A score from 0 to 1: of a JSON object by the first known key with a number, of a JSON number, else of the first
    fraction below one in the text, else of the first decimal (above one: out of 100); else null. `loose`, as matrices
    take it: a fraction may stand inside another number, and whole numbers count as decimals."""
    number = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
    held = lambda v: F.when(v.rlike(number), v.cast("double"))
    found = lambda pattern, i: F.nullif(F.regexp_extract(reply, pattern, i), F.lit("")).cast("double")
    json = F.coalesce(*[held(F.get_json_object(reply, f"$.{k}")) for k in SCORE_KEYS], held(F.trim(reply)))
    small = found(r"0?\.[0-9]+", 0) if loose else found(r"(?:^|[^0-9.])(0?\.[0-9]+)(?:[^0-9.]|$)", 1)
    large = found(r"\b([0-9]+(?:\.[0-9]+)?)\b", 1) if loose else found(r"(?:^|[^0-9.])([0-9]+\.[0-9]+)(?:[^0-9.]|$)", 1)
    return clamp(F.coalesce(json, small, F.when(large > 1, large / 100).otherwise(large)))


def context_precision(reply: Column) -> Column:
    """The share of a JSON object's numbers that are 0.5 or more, else the single score."""
    values = F.filter(F.map_values(F.from_json(reply, "map<string,double>")), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda x: x >= 0.5)) / F.size(values)).otherwise(parse_score(reply))


def judge_requests(rows: DataFrame, blank_score: float = 0.0) -> DataFrame:
    """(query_id, question, answer, contexts) -> one request per metric, with `blank_score` instead where the answer or
    the contexts are blank (0, or NaN for matrices, whose means leave it out)."""
    blank = (F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.trim(F.coalesce("contexts", F.lit(""))) == "")
    prompt = lambda task: F.concat(F.lit(task + " Reply with JSON {\"score\": number from 0 to 1}.\n\nQuestion: "), F.col("question"), F.lit("\n\nContexts:\n"), F.col("contexts"), F.lit("\n\nAnswer: "), F.col("answer"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(~blank, prompt(t)).alias("prompt"), F.when(blank, F.lit(blank_score)).alias("score")) for m, t in METRICS.items()])
    return rows.select("query_id", F.inline(each))


def evaluate_matrix(results: DataFrame, axes: tuple[str, ...] = ("embed", "llm", "mode"), value: str = "value", metric: str = "metric") -> DataFrame:
    """Mean of each metric in each cell, with totals along the last axis (null there). A cell without a value is `ERR`
    in `status`."""
    d = results.groupBy(*axes[:-1], metric, F.col(axes[-1])).agg(F.sum(value).alias("_s"), F.count(value).alias("n"))
    whole = d.groupBy(*axes[:-1], metric).agg(F.sum("_s").alias("_s"), F.sum("n").alias("n")).withColumn(axes[-1], F.lit(None).cast("string"))
    d = d.unionByName(whole)
    return d.select(*axes, metric, "n", rounded(F.col("_s") / F.nullif(F.col("n"), F.lit(0)), 4).alias("mean"), F.when(F.col("n") > 0, "ok").otherwise("ERR").alias("status"))


def matrix_table(cells: DataFrame, modes: list[str]) -> DataFrame:
    """One row per embedder, model and metric, one column per mode; `ERR` for a failed cell, `-` for none."""
    shown = F.when(F.col("status") == "ERR", "ERR").otherwise(F.format_string("%.4f", "mean"))
    return cells.groupBy("embed", "llm", "metric").agg(*[F.coalesce(F.max(F.when(F.col("mode") == m, shown)), F.lit("-")).alias(m) for m in modes])


def best_in_column(cells: DataFrame) -> DataFrame:
    """The best mode of each metric, and by which share it is above the worst."""
    w = Window.partitionBy("embed", "llm", "metric").orderBy(F.desc("mean"), "mode")
    low = F.min("mean").over(Window.partitionBy("embed", "llm", "metric"))
    d = cells.where("mode is not null and status = 'ok'").withColumn("_k", F.row_number().over(w)).withColumn("_low", low).where("_k = 1")
    return d.select("embed", "llm", "metric", "mode", "mean", F.when(F.col("_low") > 0, rounded((F.col("mean") - F.col("_low")) / F.col("_low"), 4)).alias("gain"))


def compare_models(cells: DataFrame, axis: str, a: str, b: str) -> DataFrame:
    """Cells of two models side by side, and whether b beats a."""
    rest = [c for c in ("embed", "llm", "mode", "metric") if c != axis]
    side = lambda m, to: cells.where((F.col(axis) == m) & F.col("mode").isNotNull()).select(*rest, F.col("mean").alias(to))
    return side(a, "a").join(side(b, "b"), rest).withColumn("b_wins", F.col("b") > F.col("a"))
