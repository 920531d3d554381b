"""Places in ordered groups of any size: rows are dealt by ranges and numbered by what the ranges hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.session import stored

#: Ranges, one row each, that are broadcast.
MOST_RANGES = 200_000


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows, stored, with `name`: each row's exact place in its group from 0, in the order of `order` (nulls first). A
    group may have any share of the rows; equal rows get places in some order. The window adds up one row a range."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ordered")
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_held"), F.min("_row").alias("_first"))
    shift = F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")
    ranges = stored(ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), shift.alias("_shift")), "ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= MOST_RANGES else ranges
    out = dealt.join(ranges, [*[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_range") == F.col("_r")])
    return out.withColumn(name, F.col("_row") + F.col("_shift")).drop("_range", "_row", "_r", "_shift", *[f"_g{i}" for i in range(len(group))])
