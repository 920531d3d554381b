"""A report that a stream keeps up to date: each micro-batch is merged into a new version, once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a report, oldest first. A version is complete once its writer's job has committed."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version:012d}"


def start(report: DataFrame, path: str) -> None:
    """Writes version 0, from which the stream goes on; a report that is there stays as it is."""
    if not versions(report.sparkSession, path):
        report.write.mode("overwrite").parquet(version_path(path, 0))


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(version_path(path, versions(spark, path)[-1]))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest `order`, of equal ones the greatest by its other columns. Partial results
    are merged, so a key of any share of the rows is no hot group. Null keys go."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("_best"))
    return best.select(key, "_best.*").select(*rows.columns)


def merged(report: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """report with the columns of rows (a key once) in the rows of the same key whose `order` isn't greater; keys that
    are new to it are added, with nulls in the columns that rows lack. Late rows so change nothing."""
    new = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c != key])
    out = report.join(new, F.col(key) == F.col("_key"), "full_outer")
    wins = F.col("_key").isNotNull() & (F.col(key).isNull() | F.col(order).isNull() | (F.col(order) <= F.col(f"_new_{order}")))
    put = {c: F.when(wins, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns if c != key}
    return out.select(*[F.coalesce(key, "_key").alias(c) if c == key else put.get(c, F.col(c)) for c in report.columns])


def upsert_into(path: str, key: str, order: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: batch i makes version i + 1 of the report at path from the version before it and
    the batch's latest row of each key. The version's number is the batch's, so a batch that is run again finds its
    version and does nothing, and one that was cut off while writing is written anew. The last `keep` versions stay for
    readers that have begun; a report's version is never written where it is read from."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, path)
        if known and known[-1] > batch_id:
            return
        report = spark.read.parquet(version_path(path, known[-1]))
        merged(report, latest(batch, key, order), key, order).write.mode("overwrite").parquet(version_path(path, batch_id + 1))
        for old in known[: max(len(known) + 1 - keep, 0)]:
            folder, fs = _folder(spark, version_path(path, old))
            fs.delete(folder, True)

    return put
