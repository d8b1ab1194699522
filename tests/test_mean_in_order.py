"""Means that stand on the edge of rounding, against a loop in the order of ids."""

from pyspark.sql import functions as F

from corpusq.functions import text


def test_means_do_not_depend_on_how_rows_are_spread(spark):
    values = [round(1 - (i * 7919 % 400) / 10000, 4) for i in range(4000)]
    d = spark.createDataFrame([(i, f"g{i % 3}", v) for i, v in enumerate(values)], "id long, g string, v double")
    want = {}
    for i, v in enumerate(values):
        total, n = want.get(f"g{i % 3}", (0.0, 0))
        want[f"g{i % 3}"] = total + v, n + 1
    want = {(g, total / n, n) for g, (total, n) in want.items()}
    for n in (1, 7, 13):
        spread = d.orderBy(F.xxhash64("id")).repartition(n)
        assert {tuple(r) for r in text.mean_in_order(spread, ["g"], "id", "v", n=F.count(F.lit(1))).collect()} == want
