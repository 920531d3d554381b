"""What several corpus operators share: shared-folder tables, bounded literal tables, skew-proof joins and running sums."""

from __future__ import annotations

import atexit
import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: White space that separates words, as a character class for Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Groups of more than 1 / HOT_SHARE of all rows are joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 512
#: Largest table that is broadcast on purpose, as rows times a bound of a row's bytes.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one in local mode, in which driver and
    executors are one process; on a cluster that is an error, as no other folder is known to be shared."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="noteforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its owner clears the folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/noteforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet to the shared folder, in folders by the columns `by`, and read back: the lineage ends, lost
    executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of literal rows; the caller bounds their number."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with their row of groups (one for each key, none null). Groups of more than total / HOT_SHARE rows,
    of which there are fewer than HOT_SHARE, are broadcast and their rows stay in place; the rest are shuffled."""
    cut = max(total // HOT_SHARE, 1)
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > cut).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    near = tagged.where(F.col("_hot")).drop("_hot")
    far = tagged.where(F.col("_hot").isNull()).drop("_hot", *others).join(groups.where(F.col(size) <= cut), key)
    return near.unionByName(far)


def pieces_for(total: int, rows: int = 200_000, least: int = 64) -> int:
    """Into how many pieces running() cuts a group, so that one of a third of all rows still makes pieces of that size."""
    return min(1 << 16, max(least, math.ceil(total / rows)))


def running(df: DataFrame, keys: list[str], order: Column, tie: list[str], values: dict[str, str], pieces: int) -> DataFrame:
    """For each column: name of values, adds under that name the sum of the column over the rows of the same keys that
    come before. The order is by order (any long, best a hash), then tie. Each group is cut into `pieces` ranges of
    order; ranges are summed apart and shifted by the totals before them, so that no task holds a whole group."""
    step = (1 << 63) // pieces * 2
    df = df.withColumn("_o", order).withColumn("_piece", F.expr(f"cast(floor((cast(_o as decimal(20,0)) + {1 << 63}) / {step}) as int)"))
    at = [*keys, "_piece"]
    whole = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy(*at).agg(*[F.sum(c).alias(f"_n_{n}") for c, n in values.items()])
    starts = starts.select(*[F.col(c).alias(f"_k_{c}") for c in at], *[F.coalesce(F.sum(f"_n_{n}").over(whole), F.lit(0)).alias(f"_s_{n}") for n in values.values()])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in at]
    own = W.partitionBy(*at).orderBy("_o", *tie).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(starts, same)
    for c, n in values.items():
        out = out.withColumn(n, F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.drop("_o", "_piece", *[f"_k_{c}" for c in at], *[f"_s_{n}" for n in values.values()])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows, stored, with _pos, each row's exact place in its group from 0 in the order of `order` (nulls first), and _n,
    the group's rows. Rows are dealt by ranges of group and order, sorted in each and numbered by what the ranges hold,
    so a group may have any share of the rows. A window adds up one row for each range; no row takes part in it."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    ranges = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    every = W.partitionBy(*group)
    before = every.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = stored(ranges.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_r"), (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_held").over(every).alias("_n")), f"{name}-ranges")
    ranges = F.broadcast(ranges) if ranges.count() * 128 <= BROADCAST_BYTES else ranges
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    out = dealt.join(ranges, [*same, F.col("_range") == F.col("_r")])
    return out.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_r", "_shift", *[f"_g_{c}" for c in group])


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two long columns that name each row for good, and their names: however often the result is read, and
    whatever executors are left, a row keeps its key. Rows that come straight from Parquet files are named by a hash of
    the file's path and the row's place in it; others are numbered once, in a copy in the shared folder."""
    names = [free_name(docs, "row_file"), free_name(docs, "row_at")]
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
        source = docs.metadataColumn("_metadata")
        return docs.withColumns({names[0]: F.xxhash64(source["file_path"]), names[1]: source["row_index"]}), names
    return stored(docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.monotonically_increasing_id()}), "numbered"), names


def without_rows(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """docs (of with_row_keys) without the rows whose keys are in gone, and without the keys. Rows stay in place while
    the keys that go fit BROADCAST_BYTES; beyond, they are joined by a shuffle."""
    gone = stored(gone.select(*keys), "gone")
    gone = F.broadcast(gone) if gone.count() * 64 <= BROADCAST_BYTES else gone
    return docs.join(gone, keys, "left_anti").drop(*keys)
