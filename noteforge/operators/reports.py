"""Snapshots and analysis reports: differences, counters, upserts, actions, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million tokens.
PRICE_IN, PRICE_OUT = 0.15, 0.6


def snapshot_diff(source: DataFrame, backup: DataFrame) -> DataFrame:
    """path, status of each path in either snapshot (path, hash): new, modified, unchanged, orphan, or error where a
    hash is empty."""
    both = source.select("path", F.col("hash").alias("s")).join(backup.select("path", F.col("hash").alias("b")), "path", "full_outer")
    status = F.when(F.col("s").isNull(), "orphan").when(F.col("b").isNull(), "new").when((F.col("s") == "") | (F.col("b") == ""), "error").when(F.col("s") == F.col("b"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def snapshot_orphans(source: DataFrame, backup: DataFrame) -> DataFrame:
    return backup.join(source, "path", "left_anti").select("path")


def snapshot_counters(diff: DataFrame, sizes: DataFrame) -> DataFrame:
    """Files and bytes by status; bytes of what would be copied."""
    return diff.join(sizes, "path", "left").groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("status").isin("new", "modified"), F.col("size"))), F.lit(0)).alias("copied_size"))


def actions(report: DataFrame) -> DataFrame:
    return report.groupBy("action").agg(F.count("*").alias("conversations"), F.count_if("has_framework").alias("frameworks"), F.round(F.avg("score"), 6).alias("avg_score"))


def failed(report: DataFrame, mark: str = "Error parsing LLM response") -> DataFrame:
    """Rows whose reasoning is the mark of a failed analysis, null-safe."""
    return report.where(F.col("reasoning").eqNullSafe(mark))


def upsert(report: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """report with action and score of new (path, action, score; a path once) in the first row, by `order`, of each of
    its paths; other rows of a path stay as they are."""
    fresh = new.select("path", F.col("action").alias("n_action"), F.col("score").alias("n_score"))
    first = report.join(fresh, "path", "left_semi").groupBy("path").agg(F.min(order).alias(order))
    out = report.join(first.join(fresh, "path"), ["path", order], "left")
    return out.withColumns({"action": F.coalesce("n_action", "action"), "score": F.coalesce("n_score", "score")}).drop("n_action", "n_score")


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 50, "yellow").otherwise("red")


def costs(report: DataFrame, all_files: int) -> DataFrame:
    """One row: tokens, dollars, seconds, their means, and the dollars that all files would take."""
    cost = F.sum("input_tokens") * F.lit(PRICE_IN) / 1e6 + F.sum("output_tokens") * F.lit(PRICE_OUT) / 1e6
    one = report.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(cost, F.lit(0.0)).alias("cost"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    mean = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("conversations")), F.lit(0.0)), 9)
    return one.select("conversations", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"), "seconds", mean("cost").alias("avg_cost"), mean("seconds").alias("avg_seconds"), F.round(F.coalesce(F.try_divide(F.col("cost"), F.col("conversations")), F.lit(0.0)) * all_files, 6).alias("projected_cost"))


def existing(report: DataFrame, files: DataFrame) -> DataFrame:
    """Archive rows with whether their file exists."""
    found = files.select("path").distinct().withColumn("there", F.lit(True))
    rows = report.where("action = 'archive'").join(found, "path", "left")
    return rows.select("path", F.when(F.col("there"), "DELETE").otherwise("MISSING").alias("status"))
