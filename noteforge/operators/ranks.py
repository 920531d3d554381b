"""Exact order statistics by group without a buffer of values: ranks are found by counting below digits of the values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType
from pyspark.sql.window import Window as W

from noteforge.session import stored

#: Groups of at most so many distinct values are summed up in value order, each in one task.
SHORT = 100_000
#: Bits of a digit: a round counts 2 ** BITS values of it for each group and rank at most.
BITS = 16
#: Groups times ranks that are broadcast.
MOST_BROADCAST = 200_000


def sortable(value: Column, real: bool) -> Column:
    """A long whose bits, read as an unsigned number, are in the order of the values; -0.0 is 0.0, NaN comes last."""
    if not real:
        return value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))


def unsorted(key: Column, real: bool) -> Column:
    """The value of a sortable() long."""
    if not real:
        return key.bitwiseXOR(F.lit(-(1 << 63)))
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(-(1 << 63)))).otherwise(F.bitwise_not(key))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """keys, name, value: the value at each asked rank (0-based, ascending, nulls left out) of each group. ranks: from a
    group's number of values to an array of structs (name, rank). value: integral, or float or double.

    Rows are counted by group and value. If some group has more than SHORT distinct values, ranks are found digit by
    digit from the top: a round counts the values of the group that share the digits found so far by their next digit,
    and keeps the digit that the rank falls on. So neither outliers nor ties nor the number of distinct values make a
    task or a buffer large; the rounds are four at most, and digits that all values share take none."""
    real = isinstance(rows.schema[value].dataType, (DoubleType, FloatType))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = stored(counts.withColumn("_u", sortable(F.col("_v"), real)), "value-counts")
    own = [f"_k{i}" for i in range(len(keys))]
    groups = stored(counts.groupBy(*own).agg(F.sum("_c").alias("_n"), F.count("*").alias("_distinct")), "value-groups")
    asked = groups.where("_n > 0").select(*own, F.explode(ranks(F.col("_n"))).alias("_t")).select(*own, F.col("_t.name").alias("name"), F.col("_t.rank").cast("long").alias("_rank"))
    most, n_groups = groups.agg(F.max("_distinct"), F.count("*")).first()
    named = [F.col(o).alias(k) for o, k in zip(own, keys, strict=True)]
    if (most or 0) <= SHORT:
        upto = F.sum("_c").over(W.partitionBy(*own).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
        found = joined(counts.withColumn("_upto", upto), asked, own, [(F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))], n_groups)
        return found.select(*named, "name", F.col("_v").alias("value"))
    signed = F.col("_u").bitwiseXOR(F.lit(-(1 << 63)))
    low, high = (x + (1 << 63) for x in counts.agg(F.min(signed), F.max(signed)).first())
    at = 64
    while at > 0 and low >> (at - BITS) == high >> (at - BITS):
        at -= BITS
    state = asked.withColumn("_p", F.lit(to_signed(low >> at) if at < 64 else 0).cast("long"))
    while at > 0:
        prefix = F.shiftrightunsigned("_u", at) if at < 64 else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("_u", at - BITS).bitwiseAND(F.lit((1 << BITS) - 1))
        hits = joined(counts.select(*own, "_c", prefix.alias("_q"), digit.alias("_d")), state, own, [F.col("_p") == F.col("_q")], n_groups)
        by = hits.groupBy(*own, "name", "_rank", "_p", "_d").agg(F.sum("_c").alias("_c"))
        upto = F.sum("_c").over(W.partitionBy(*own, "name", "_rank").orderBy("_d").rowsBetween(W.unboundedPreceding, 0))
        by = by.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        state = by.select(*own, "name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), (F.shiftleft("_p", BITS).bitwiseOR(F.col("_d"))).alias("_p"))
        state, at = stored(state, "ranks"), at - BITS
    return state.select(*named, "name", unsorted(F.col("_p"), real).cast(rows.schema[value].dataType if real else LongType()).alias("value"))


def to_signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def joined(rows: DataFrame, asked: DataFrame, own: list[str], more: list[Column], n_groups: int) -> DataFrame:
    """rows joined with what is asked of their group, null keys with null keys."""
    other = asked.select(*[F.col(k).alias(f"{k}_") for k in own], *[c for c in asked.columns if c not in own])
    other = F.broadcast(other) if n_groups <= MOST_BROADCAST // 8 else other
    return rows.join(other, [*[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in own], *more]).drop(*[f"{k}_" for k in own])


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and, as `name`, the exact median: the mean of the two middle values where their number is even. Groups
    without a value have no row."""
    middle = lambda n: F.array(*[F.struct(F.lit(i).alias("name"), x.alias("rank")) for i, x in enumerate((F.floor((n - 1) / 2), F.floor(n / 2)))])
    found = at_ranks(rows, keys, value, middle)
    return found.groupBy(*keys).agg(F.avg(F.col("value").cast("double")).alias(name))
