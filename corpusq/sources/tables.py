"""Maintenance of chunk tables: upsert, delete, information per dataset, column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from corpusq.functions.text import rounded


def upsert(table: DataFrame, chunks: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key; columns that one side lacks are null there. Of rows
    of equal order any one stays. Combined before the shuffle."""
    both = table.unionByName(chunks, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.col(order)).alias("_row")).select(key, "_row.*")


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the ids. Spark broadcasts the ids if their size allows."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def collection_info(chunks: DataFrame, dataset: str, vector: str) -> DataFrame:
    """Points and vectors of each dataset; one without any vector is 'empty', else 'green'."""
    d = chunks.groupBy(dataset).agg(F.count(F.lit(1)).alias("points"), F.count(vector).alias("vectors"))
    return d.withColumn("status", F.when(F.col("vectors") > 0, "green").otherwise("empty"))


def dataset_bytes(docs: DataFrame, dataset: str, text: str, update: str) -> DataFrame:
    """Bytes of text and the last update of each dataset; null text has none."""
    return docs.groupBy(dataset).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"), F.max(update).alias("last_update"))


def kind(column_type) -> str:
    if isinstance(column_type, BooleanType):
        return "bool"
    return "string" if isinstance(column_type, StringType) else "numeric" if isinstance(column_type, NumericType) else column_type.simpleString()


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, kind, n_nulls, mean_length) for each column, in one pass; the length only for text."""
    is_text = {f.name: isinstance(f.dataType, StringType) for f in df.schema}
    one = [F.struct(F.lit(f.name).alias("column"), F.lit(kind(f.dataType)).alias("kind"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_nulls"), (rounded(F.avg(F.length(f"`{f.name}`")), 4) if is_text[f.name] else F.lit(None).cast("double")).alias("mean_length")) for f in df.schema]
    return df.agg(F.array(*one).alias("_all")).select(F.inline("_all"))
