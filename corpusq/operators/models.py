"""Models by name: a factory loads one in a task, batches go through it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusq.functions.text import rounded

#: What a model makes of a batch: scores of (query, text) pairs.
Scorer = Callable[[list[str], list[str]], list[float]]


class Registry:
    """Factories by name. A factory is called once in each task that uses the model, never on the driver."""

    def __init__(self, kind: str) -> None:
        self.kind, self.factories, self.bounded = kind, {}, {}

    def register(self, name: str, factory: Callable[[], Callable], bounded: bool = False) -> None:
        """`bounded`: the model's scores lie between 0 and 1 as they are."""
        self.factories[name], self.bounded[name] = factory, bounded

    def factory(self, name: str) -> Callable[[], Callable]:
        if name not in self.factories:
            raise ValueError(f"unknown {self.kind} {name}; there are {', '.join(sorted(self.factories)) or 'none'}")
        return self.factories[name]


def shared_words() -> Scorer:
    """The share of the query's different words that the text has."""
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))

    def score(queries: list[str], texts: list[str]) -> list[float]:
        own = {q: words(q) for q in set(queries)}
        return [len(own[q] & words(t)) / len(own[q]) if own[q] else 0.0 for q, t in zip(queries, texts, strict=True)]

    return score


def shared_counts() -> Scorer:
    """The logarithm of how often the text has words of the query, which has no bounds."""
    count = lambda t: re.findall(r"[^\W_]+", t.lower())

    def score(queries: list[str], texts: list[str]) -> list[float]:
        return [float(np.log(0.5 + sum(w in own for w in count(t)))) for q, t in zip(queries, texts, strict=True) for own in [set(count(q))]]

    return score


RERANKERS = Registry("reranker")
RERANKERS.register("shared-words", shared_words, bounded=True)
RERANKERS.register("shared-counts", shared_counts)


def with_scores(pairs: DataFrame, factory: Callable[[], Scorer], query: str = "query", text: str = "text", to: str = "score", batch: int = 256) -> DataFrame:
    """The pairs with the model's score of each. The model is loaded once a task, when its first pair comes, and gets at
    most `batch` pairs at once; null query or text are empty. Another number of scores than of pairs is an error, and so
    is what is no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            scores: list[float] = []
            for a in range(0, b.num_rows, batch):
                model = model or factory()
                part = b.slice(a, batch)
                q, t = ([x or "" for x in part.column(c).to_pylist()] for c in (query, text))
                made = np.asarray(model(q, t), float).ravel()
                if len(made) != part.num_rows or np.isnan(made).any():
                    raise ValueError(f"{np.isfinite(made).sum()} scores for {part.num_rows} pairs")
                scores += made.tolist()
            yield pa.record_batch([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, to])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(to, DoubleType())]))


def normalized(hits: DataFrame, bounded: bool, score: str = "score", equal: float | None = 0.5) -> DataFrame:
    """Scores between 0 and 1 by query: as they are if the model bounds them, else from the lowest to the highest. Where all
    are equal they become `equal`, or stay if that is None."""
    if bounded:
        return hits
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    same = F.col(score) if equal is None else F.lit(float(equal))
    return hits.withColumn(score, F.when(high == low, same).otherwise(rounded((F.col(score) - low) / (high - low), 6)))


def rerank_by(hits: DataFrame, k: int, model: str = "shared-words", registry: Registry = RERANKERS, batch: int = 256) -> DataFrame:
    """(query_id, query, chunk_id, text, score) -> the k best of each query by the named model, with normalized scores; the
    earlier score is kept as cosine_score. Ties go to the smaller chunk_id. Nothing in, nothing out."""
    factory = registry.factory(model)
    d = with_scores(hits.withColumnRenamed("score", "cosine_score").drop("rank"), factory, batch=batch)
    d = normalized(d.withColumn("score", rounded(F.col("score"), 6)), registry.bounded[model])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
