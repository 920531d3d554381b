"""Order statistics against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from noteforge.operators import ranks, stats


@pytest.mark.parametrize("short", [100_000, 0])
def test_medians_of_longs_and_doubles(spark, monkeypatch, short):
    """By one window a group and by digits: outliers, ties, negative values, nulls, a null group, one value."""
    monkeypatch.setattr(ranks, "SHORT", short)
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.randint(-50, 50), rng.randint(-(2**40), 2**40), 7, -(2**63), 2**63 - 1]), rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e300), 0.0, -0.0, 5e-324, float("inf"), -float("inf"), 1.5])) for g in (None, "a", "b") for _ in range(101)]
    rows += [("one", 5, 5.5), ("two", 1, 1.0), ("two", 2, 4.0), ("none", None, None), ("a", None, None)]
    df = spark.createDataFrame(rows, "g string, n long, x double").repartition(3)
    for column, i in (("n", 1), ("x", 2)):
        got = {r["g"]: r["m"] for r in ranks.medians(df, ["g"], column, "m").collect()}
        want = {g: [r[i] for r in rows if r[0] == g and r[i] is not None] for g in {r[0] for r in rows}}
        assert got == {g: float(statistics.median(v)) for g, v in want.items() if v}
    assert ranks.medians(df.where("false"), ["g"], "n", "m").count() == 0


@pytest.mark.parametrize("short", [100_000, 0])
def test_nearest_rank(spark, monkeypatch, short):
    monkeypatch.setattr(ranks, "SHORT", short)
    for values in ([4, 2, 3, 1], list(range(1, 101)), [None, None, 5, 1], [9], [3] * 50 + [2**62], [None]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = sorted((r["percent"], r["value"]) for r in stats.nearest_rank(df, "v").collect())
        ordered = sorted(values, key=lambda v: (v is not None, v or 0))
        assert got == [(p, ordered[len(values) * p // 100]) for p in (50, 75, 80, 90, 95, 99)]
    assert stats.nearest_rank(spark.createDataFrame([], "v long"), "v").count() == 0


def test_a_million_distinct_values_and_an_outlier(spark):
    """Beyond SHORT; every shuffle's partitions hold few rows, whatever the values."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 7, F.lit(2**60)).otherwise(F.col("id") * 3).alias("v"))
    assert ranks.medians(df, ["g"], "v", "m").first()["m"] == 1_500_001.5
    got = {r["percent"]: r["value"] for r in stats.nearest_rank(df, "v").collect()}
    assert got[50] == 3 * 500_001 and got[99] == 3 * 990_001
