"""Analysis reports and statistics as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "path string, title string, analysis struct<quality_score:double, is_valuable:boolean, primary_topics:array<string>, reasoning:string, "
    "has_framework:boolean, framework_description:string, key_questions:array<string>, suggested_action:string, input_tokens:long, output_tokens:long, processing_time:double>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report: a JSON array over lines, with nested analyses."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


def write_stats(rows: DataFrame, path: str) -> None:
    """A row of statistics as a JSON object on each line; nulls are written too."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def pending(rows: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """rows that a stopped run left: those whose key is not among its results. A run adds to its results by
    add_results, so it can go on from what is there."""
    return rows.join(done.select(key), key, "left_anti")


def add_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_merged(notes: DataFrame, group: str, title: str, body: str, order: str, path: str) -> None:
    """stats.merged_document as text files: a folder for each group, in which the files, by name, hold its notes in
    order. Rows are dealt by range of group and order, so a group of any size is spread and none is held in one row."""
    first = notes.groupBy(F.col(group).alias("_of")).agg(F.min(order).alias("_first"))
    rule = F.when(F.col(order) > F.col("_first"), "=" * 80 + "\n").otherwise("")
    rows = notes.join(first, F.col(group).eqNullSafe(F.col("_of"))).select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.concat(rule, title, F.lit("\n"), body).alias("value"))
    rows = rows.repartitionByRange("_group", "_order").sortWithinPartitions("_group", "_order")
    rows.select(F.col("_group").alias(group), "value").write.mode("errorifexists").partitionBy(group).text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Writes a new version: a report is never written where it is read from."""
    rows.write.mode("errorifexists").json(path)
