"""The live status stream against the status of all events."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusq.operators import evaluation
from corpusq.streaming import status


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, status.PROVIDER)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


SCHEMA = "job string, seq long, state string, done long, note string"


def run(spark, tmp_path, batches, keep, done, shrinks=False):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found, size = {}, []

    def take(df, number):
        for r in df.collect():
            found[r.job] = (r.state, r.done, r.note)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = status.live_status(stream, "job", ["seq"], ["state", "done", "note"], "state", keep)
    q = out.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (done(found) and size):  # timers keep such a query running, so it is stopped
            time.sleep(0.3)
            size = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
        while time.time() < until and shrinks and size[-1] == max(size):
            time.sleep(0.3)
            size = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    finally:
        q.stop()
    return found, size


def test_equals_the_status_of_all_events_whatever_the_batches(spark, rocks, tmp_path):
    rnd = random.Random(8)
    rows = [(f"j{rnd.randrange(9)}", k, rnd.choice([None, "queued", "running", "running", "completed"]), rnd.choice([None, k]), rnd.choice([None, f"n{k}"])) for k in range(200)]
    want = {r.job: (r.state, r.done, r.note) for r in evaluation.latest_status(spark.createDataFrame(rows, SCHEMA), "job", ["seq"], ["state", "done", "note"]).collect()}
    late = list(rows)
    rnd.shuffle(late)
    for name, order, n in (("a", rows, 50), ("b", late, 67)):
        (tmp_path / name).mkdir()
        found, _ = run(spark, tmp_path / name, [order[i : i + n] for i in range(0, len(rows), n)], 3600, lambda x: x == want)
        assert found == want, (found, want)


def test_ended_jobs_are_forgotten(spark, rocks, tmp_path):
    batches = [[(f"j{i}", 0, "completed" if i < 8 else "running", 1, "a") for i in range(10)], [("j9", 1, None, 2, "a")], [("j9", 2, None, 3, None)], [("j9", 3, None, 4, None)]]
    found, size = run(spark, tmp_path, batches, 1, lambda x: x.get("j9", (0, 0))[1] == 4, True)
    assert found["j9"] == ("running", 4, "a") and found["j0"] == ("completed", 1, "a")
    assert max(size) >= 10 and size[-1] < max(size)
