"""Chunk tables in versions."""

import pytest
from pyspark.sql import functions as F

from corpusq.sources.snapshots import ChunkTable

SCHEMA = "doc_id long, chunk int, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_delete_and_late_rows(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 4)
    with pytest.raises(ValueError):
        t.read()
    assert t.merge() == 0
    first = [(i, k, f"{i}.{k}") for i in range(20) for k in range(i % 3 + 1)] + [(None, 0, "none")]
    assert t.merge(spark.createDataFrame(first, SCHEMA), 1) == 1
    assert rows(t.read()) == sorted(first, key=repr)
    new = [(3, 0, "new"), (50, 0, "more")]
    assert t.merge(spark.createDataFrame(new, SCHEMA), 2, gone=spark.createDataFrame([(4,), (99,)], "doc_id long")) == 2
    want = sorted([r for r in first if r[0] not in (3, 4)] + new, key=repr)
    assert rows(t.read()) == want and rows(t.read(1)) == sorted(first, key=repr)
    # older rows change nothing, the same rows again change nothing
    t.merge(spark.createDataFrame([(3, 0, "old"), (4, 0, "old")], SCHEMA), 1)
    t.merge(spark.createDataFrame(new, SCHEMA), 2)
    assert rows(t.read()) == want
    t.merge(spark.createDataFrame([(4, 0, "back")], SCHEMA), 3)
    assert (4, 0, "back") in rows(t.read())
    t.delete(spark.createDataFrame([(None,), (50,)], "doc_id long"), 9)
    assert not {None, 50} & {r[0] for r in rows(t.read())}
    again = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 999)
    assert again.buckets == 4 and rows(again.read()) == rows(t.read())


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 16)
    t.merge(spark.createDataFrame([(i, 0, "x") for i in range(200)], SCHEMA))
    before = t.manifest()["parts"]
    t.merge(spark.createDataFrame([(7, 0, "y")], SCHEMA), 1)
    after = t.manifest()["parts"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1


def test_failed_change_keeps_the_version(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 4)
    t.merge(spark.createDataFrame([(i, 0, "x") for i in range(10)], SCHEMA))
    bad = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("y").alias("text"))
    with pytest.raises(Exception, match="broken"):
        t.merge(bad, 1)
    assert t.version() == 1 and {r.text for r in t.read().collect()} == {"x"}
    t.vacuum()
    assert len(t._names(f"{t.path}/data")) == 1 and t.read().count() == 10


def test_two_writers(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 2)
    t.merge(spark.createDataFrame([(1, 0, "x")], SCHEMA))
    schema, parts = t._rows(t.manifest()).schema, t.manifest()["parts"]
    t._publish(2, schema, parts)
    with pytest.raises(RuntimeError):
        t._publish(2, schema, parts)
    assert t.versions() == [1, 2]


def test_new_columns_and_rewriting(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id", 4)
    t.merge(spark.createDataFrame([(i, 0, "x") for i in range(8)], SCHEMA))
    t.merge(spark.createDataFrame([(1, 0, "y", 0.5)], SCHEMA + ", score double"), 1)
    assert {(r.doc_id, r.score) for r in t.read().collect()} == {(i, 0.5 if i == 1 else None) for i in range(8)}
    t.rewrite(lambda d: d.withColumn("n", F.length("text")))
    assert {r.n for r in t.read().collect()} == {1} and t.version() == 3
    t.vacuum()
    assert t.versions() == [3] and t.read().count() == 8


def test_empty_rows(spark, tmp_path):
    t = ChunkTable(spark, str(tmp_path / "t"), "doc_id")
    t.merge(spark.createDataFrame([], SCHEMA))
    assert t.version() == 1 and t.read().count() == 0
