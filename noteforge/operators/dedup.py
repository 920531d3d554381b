"""Duplicates: equal content, equal names, similar lines; what is kept and what would be moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.functions import arrow, text


def hash_groups(files: DataFrame) -> DataFrame:
    """hash, copies, bytes that could go, for hashes of more than one file. Counted before the shuffle."""
    by = files.groupBy("hash").agg(F.count("*").alias("copies"), F.sum("size").alias("total_size"), F.max("size").alias("kept_size"))
    return by.where("copies > 1").select("hash", "copies", (F.col("total_size") - F.col("kept_size")).alias("removable_size"))


def hash_summary(files: DataFrame) -> DataFrame:
    """One row: groups, duplicates (all but one of each group) and their bytes."""
    return hash_groups(files).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("removable_size"), F.lit(0)).alias("removable_size"))


def keep_one(files: DataFrame, key: str) -> DataFrame:
    """Files with equal hashes and the one that stays: the largest, then the first by name and by path. The keeper is an
    aggregate, combined before the shuffle, and joined back: a hot hash is never sorted in one task."""
    first = F.min(F.struct(-F.col("size"), F.col("name").alias("n"), F.col(key).alias("kept"))).alias("f")
    keepers = files.groupBy("hash").agg(first, F.count("*").alias("copies")).where("copies > 1").select("hash", "copies", F.col("f.kept").alias("kept"))
    return files.join(keepers, "hash").select(key, "hash", "copies", "kept", (F.col(key) == F.col("kept")).alias("is_kept"))


def name_groups(notes: DataFrame) -> DataFrame:
    """Notes whose name is `base (n).md` or `base.md` in a group with some n > 0: path, base, number, original (the
    lowest number, then path), is_original."""
    base, n = text.duplicate_name(F.col("name"))
    named = notes.select("doc_id", "path", base.alias("base"), n.alias("number"))
    first = named.groupBy("base").agg(F.min(F.struct("number", "path")).alias("f"), F.max("number").alias("most")).where("most > 0")
    return named.join(first.select("base", F.col("f.path").alias("original")), "base").withColumn("is_original", F.col("path") == F.col("original"))


def similar_to_original(notes: DataFrame, least: float = 0.95) -> DataFrame:
    """Members of name groups whose lines are like their original's. Equal contents and hopeless numbers of lines are
    settled without the line matcher."""
    grouped = name_groups(notes).join(notes.select("path", "content"), "path")
    originals = grouped.where("is_original").select("base", F.col("content").alias("o_content"))
    pairs = grouped.where("not is_original").join(originals, "base")
    a, b = F.size(text.lines(F.col("o_content"))), F.size(text.lines(F.col("content")))
    bound = F.coalesce(F.try_divide(2.0 * F.least(a, b), a + b), F.lit(1.0))
    pairs = pairs.withColumns({"equal": F.col("content") == F.col("o_content"), "bound": bound}).where((F.col("bound") >= least) | F.col("equal"))
    scored = pairs.where("equal").withColumn("ratio", F.lit(1.0)).unionByName(pairs.where("not equal").withColumn("ratio", arrow.line_similarity("o_content", "content")))
    return scored.where(F.col("ratio") >= least).select("path", "original", "ratio")


def diffs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    return pairs.withColumn("diff", arrow.unified_diff(old, new))
