"""Adaptive time partitions: a table as Parquet files of bounded rows, cut by years, months, days or hours as they fill."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from noteforge.llm.common import BROADCAST_BYTES, free_name, shared_dir, small_table, stored, with_row_keys
from noteforge.session import ship_package

#: Calendar levels. A node's key: its year, its month since year 0, its day or its hour since 1970.
LEVELS = ("year", "month", "day", "hour")
#: The leaf of the rows without a moment.
NO_MOMENT = "null"


@dataclass(frozen=True)
class Leaf:
    """A run of sibling nodes that shares files: its text, its rows, and its members that hold rows, as (level, key)."""

    text: str
    rows: int
    members: tuple[tuple[int, int], ...]

    def parts(self, limit: int) -> list[int]:
        """The rows of each part."""
        return [min(limit, self.rows - i) for i in range(0, self.rows, limit)]


# --- the layout --------------------------------------------------------------------------------------------------------


def node_keys(moment: Column) -> list[Column]:
    """The keys of a moment's year, month, day and hour."""
    day = F.unix_date(F.to_date(moment))
    return [F.year(moment), F.year(moment) * 12 + F.month(moment) - 1, day, day * 24 + F.hour(moment)]


def children(level: int, key: int) -> range:
    """The keys one level below a node, all of the calendar's."""
    if level == 0:
        return range(key * 12, key * 12 + 12)
    if level == 1:
        first = [int(np.datetime64(key + i - 1970 * 12, "M").astype("datetime64[D]").astype(int)) for i in (0, 1)]
        return range(*first)
    return range(key * 24, key * 24 + 24)


def member_name(level: int, key: int) -> str:
    if level == 0:
        return f"{key:04d}"
    if level == 1:
        return f"{key % 12 + 1:02d}"
    if level == 2:
        return str(np.datetime64(key, "D"))[-2:]
    return f"{key % 24:02d}"


def node_counts(hours: DataFrame, limit: int, values: list[str]) -> list[dict[int, list[int]]]:
    """For each level, the counts by key, of the years and of those below a node of more than limit rows by the last of
    values. No more than rows / limit nodes of a level are that large, so at most 31 times as many rows come to the
    driver, besides one for each year, whatever the table's size."""
    out: list[dict[int, list[int]]] = []
    part = hours
    for i, level in enumerate(LEVELS):
        if i:
            part = hours.where(F.col(LEVELS[i - 1]).isin([k for k, v in out[-1].items() if v[-1] > limit]))
        rows = part.where(f"{level} is not null").groupBy(level).agg(*[F.sum(v).alias(v) for v in values]).collect()
        out.append({r[0]: list(r[1:]) for r in rows})
    return out


def calendar(counts: list[dict[int, list[int]]], limit: int, which: int, no_moment: int = 0) -> list[Leaf]:
    """The leaves in time order. A node above limit is split into all its children; in order, each sibling within limit
    joins the run of the sibling straight before it if that stays within limit, else it starts one. An hour is never
    split. Runs without rows are no leaves; no_moment rows without a moment make the last."""
    leaves: list[Leaf] = []

    def fit(parents: str, level: int, keys: range) -> None:
        run, rows = [], 0

        def close() -> None:
            if rows:
                held = tuple((level, k) for k in run if counts[level].get(k, zero)[which])
                leaves.append(Leaf(f"{parents}{member_name(level, run[0])}-{member_name(level, run[-1])}", rows, held))

        for k in keys:
            n = counts[level].get(k, zero)[which]
            if n > limit and level < 3:
                close()
                run, rows = [], 0
                fit(f"{parents}{member_name(level, k)}/", level + 1, children(level, k))
            elif run and rows + n <= limit:
                run, rows = [*run, k], rows + n
            else:
                close()
                run, rows = [k], n
        close()

    zero = [0] * (which + 1)
    years = [y for y, v in counts[0].items() if v[which]]
    if years:
        fit("", 0, range(min(years), max(years) + 1))
    return leaves + ([Leaf(NO_MOMENT, no_moment, ())] if no_moment else [])


def row_hash(columns: list[str], seed: int) -> Column:
    """64 bits of a row's values; nulls count."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`"), F.isnull(f"`{c}`"))])


# --- files -------------------------------------------------------------------------------------------------------------


class TimeLayout:
    """A table's files by time in one folder: write() puts rows there, rewrite() brings the folder to a larger set of
    rows and leaves every file alone whose leaf, part and rows recur. limit: the most rows of a file. Files: folder /
    leaf (with . for /) / part, one Parquet file each with the table's columns, rows by moment, `order` and then by value.

    Null moments are the leaf `null`; nulls in `order` come first; repeated rows stay rows; an empty table writes no
    file; helper columns get names that the table doesn't have. Columns have to be hashable (no maps)."""

    def __init__(self, rows: DataFrame, moment: Column, order: list[str], new: Column, limit: int, folder: str):
        """new: whether a row is only in the second layout, by the row's own values; null counts as true."""
        self.columns, self.schema = rows.columns, rows.schema
        self.limit, self.folder, self.spark = limit, folder, rows.sparkSession
        self.leaf, self.part = free_name(rows, "leaf"), free_name(rows, "part")
        self.new = F.coalesce(new, F.lit(True))
        rows, keys = with_row_keys(rows)
        self.names = {n: free_name(rows, f"_{n}") for n in (*LEVELS, "moment", "new", "value", "base", "file", "range", "rank", "large", "node0", "node1", "node2", "node3")}
        value = row_hash(self.columns, 0)
        rows = rows.withColumn(self.names["moment"], moment).withColumns({self.names["new"]: self.new, self.names["value"]: value})
        self.rows = rows.withColumns({self.names[n]: k for n, k in zip(LEVELS, node_keys(F.col(self.names["moment"])), strict=True)})
        self.order = [F.col(f"`{c}`") for c in (self.names["moment"], *order, self.names["value"], *keys)]
        hours = self.rows.groupBy(*[F.col(self.names[n]).alias(n) for n in LEVELS]).agg(F.sum((~F.col(self.names["new"])).cast("long")).alias("old"), F.count("*").alias("all"))
        hours = stored(hours, "hours")
        counts = node_counts(hours, limit, ["old", "all"])
        none = hours.where("hour is null").agg(F.sum("old"), F.sum("all")).first()
        self.before, self.after = (calendar(counts, limit, i, none[i] or 0) for i in (0, 1))

    def placed(self, rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
        """rows with their leaf, its first file's number and their rank in the leaf where it has several parts, else 0.
        The map from nodes to leaves is broadcast: it has a row for each member, of which node_counts() bounds the
        number. A leaf of several parts is an hour or has no moment, and may hold any share of the rows: its rows are
        dealt by ranges of the order, and a window numbers each range apart from the others."""
        n = self.names
        firsts = np.cumsum([0, *[len(x.parts(self.limit)) for x in leaves]])
        found: list[Column] = []
        for i, level in enumerate(LEVELS):
            members = [{"k": k, "t": x.text.replace("/", "."), "b": int(firsts[j]), "l": x.rows > self.limit} for j, x in enumerate(leaves) for at, k in x.members if at == i]
            if members:
                nodes = small_table(self.spark, members, "k long, t string, b int, l boolean")
                nodes = nodes.select(F.col("k").alias(n[level]), F.struct("t", "b", "l").alias(n[f"node{i}"]))
                rows = rows.join(F.broadcast(nodes), n[level], "left")
                found.append(F.col(n[f"node{i}"]))
        if leaves and leaves[-1].text == NO_MOMENT:
            found.append(F.struct(F.lit(NO_MOMENT).alias("t"), F.lit(int(firsts[-2])).alias("b"), F.lit(leaves[-1].rows > self.limit).alias("l")))
        node = F.coalesce(*found) if found else F.lit(None).cast("struct<t:string,b:int,l:boolean>")
        rows = rows.withColumns({self.leaf: F.coalesce(node["t"], F.lit("")), n["base"]: node["b"], n["large"]: node["l"]}).drop(*[n[f"node{i}"] for i in range(4)])
        whole = rows.where(~F.col(n["large"])).drop(n["large"]).withColumn(n["rank"], F.lit(0).cast("long"))
        if not any(x.rows > self.limit for x in leaves):
            return whole
        large = rows.where(n["large"]).drop(n["large"])
        large = stored(large.repartitionByRange(self.leaf, *self.order).withColumn(n["range"], F.spark_partition_id()), "large-leaves")
        before = W.partitionBy("_l").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
        ranges = large.groupBy(F.col(self.leaf).alias("_l"), F.col(n["range"]).alias("_r")).agg(F.count("*").alias("_n"))
        ranges = stored(ranges.select("_l", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")), "large-ranges")
        ranges = F.broadcast(ranges) if ranges.count() * 128 <= BROADCAST_BYTES else ranges
        number = F.row_number().over(W.partitionBy(self.leaf, n["range"]).orderBy(*self.order))
        large = large.withColumn(n["rank"], number).join(ranges, (F.col(self.leaf) == F.col("_l")) & (F.col(n["range"]) == F.col("_r")))
        return whole.unionByName(large.withColumn(n["rank"], F.col(n["rank"]) + F.col("_shift") - 1).drop("_l", "_r", "_shift", n["range"]))

    def put(self, placed: DataFrame, n_files: int, kept: list[int]) -> None:
        """Writes the files but for the kept numbers: each gets the rows of one file, in their order, as one task."""
        part = F.expr(f"cast({self.names['rank']} div {self.limit} as int)")
        rows = placed.withColumn(self.part, part + 1).withColumn(self.names["file"], F.col(self.names["base"]) + part)
        rows = rows.where(~F.col(self.names["file"]).isin(kept)) if kept else rows
        rows = rows.repartitionById(max(n_files, 1), F.col(self.names["file"])).sortWithinPartitions(self.leaf, self.part, *self.order)
        rows.select(*[f"`{c}`" for c in self.columns], self.leaf, self.part).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(self.leaf, self.part).parquet(self.folder)

    def write(self) -> None:
        """The files of the rows that aren't new."""
        files = [p for x in self.before for p in x.parts(self.limit)]
        if files:
            self.put(self.placed(self.rows.where(~F.col(self.names["new"])), self.before), len(files), [])

    def contents(self, rows: DataFrame, part: Column) -> dict[tuple[str, int], tuple]:
        """What each file holds, by (leaf, part): its rows and the sums of two 64-bit hashes of them. Rows are sorted by
        value, so equal contents mean equal files. One row for each file comes to the driver, and files are bounded."""
        sums = [F.sum(row_hash(self.columns, seed).cast("decimal(20,0)")) for seed in (0, 1)]
        return {(r[0].replace(".", "/"), r[1]): tuple(r[2:]) for r in rows.groupBy(self.leaf, part).agg(F.count("*"), *sums).collect()}

    def rewrite(self) -> list[tuple[str, int]]:
        """Brings the folder to all rows and returns the (leaf, part) of the files that stayed. New files are written
        first, by a job that commits all or none; then the old ones go."""
        placed = self.placed(self.rows, self.after)
        number = {(x.text, i + 1): n for n, (x, i) in enumerate((x, i) for x in self.after for i in range(len(x.parts(self.limit))))}
        old = self.paths().collect() if self.before else []
        held = self.contents(self.read(), F.col(self.part)) if old else {}
        wanted = self.contents(placed, F.expr(f"{self.names['rank']} div {self.limit} + 1")) if old else {}
        stayed = [k for k in number if k in held and held[k] == wanted[k]]
        if len(stayed) < len(number):
            self.put(placed, len(number), [number[k] for k in stayed])
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        keep = set(stayed)
        for r in old:
            if (r["leaf"], r["part"]) not in keep:
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["path"]))
                path.getFileSystem(conf).delete(path, False)
        return stayed

    def read(self) -> DataFrame:
        """The folder's rows with leaf, part and Spark's _metadata. Read by a given schema, so that no leaf's text is
        taken for a date."""
        schema = StructType([*self.schema.fields, StructField(self.leaf, StringType()), StructField(self.part, LongType())])
        return self.spark.read.schema(schema).parquet(self.folder)

    def paths(self) -> DataFrame:
        """leaf, part, path of every file."""
        rows = self.read()
        path = rows.metadataColumn("_metadata")["file_path"]
        return rows.select(F.replace(self.leaf, F.lit("."), F.lit("/")).alias("leaf"), F.col(self.part).alias("part"), path.alias("path")).distinct()

    def files(self, id_col: str) -> DataFrame:
        """leaf, part, path, n_rows, n_new and ids_sha256 of every file, as read back: the SHA-256 of the decimal ids in
        file order, comma-joined (null: empty). Only ids move; a file's go through one task as a stream."""
        ship_package(self.spark)
        rows = self.read()
        at = rows.metadataColumn("_metadata")["row_index"]
        ids = rows.select(F.col(self.leaf).alias("leaf"), F.col(self.part).alias("part"), at.alias("at"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), self.new.alias("new"))
        ids = ids.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "at").select("leaf", "part", "id", "new")
        out = ids.mapInArrow(file_digests, "leaf string, part long, n_rows long, n_new long, ids_sha256 string")
        return out.withColumn("leaf", F.replace("leaf", F.lit("."), F.lit("/"))).join(self.paths(), ["leaf", "part"])


def file_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal (leaf, part), holding one batch at a time."""
    names = ["leaf", "part", "n_rows", "n_new", "ids_sha256"]
    at, n_rows, n_new, sha = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, (*at, n_rows, n_new, sha.hexdigest()), strict=True)})

    for batch in batches:
        leaf, part, ids, new = (c.to_pylist() if i < 3 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(batch.columns))
        starts = [i for i in range(len(leaf)) if i == 0 or part[i] != part[i - 1] or leaf[i] != leaf[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True):
            if (leaf[a], part[a]) != at:
                if at:
                    yield row()
                at, n_rows, n_new, sha = (leaf[a], part[a]), 0, 0, hashlib.sha256()
            sha.update(("," * bool(n_rows) + ",".join(ids[a:b])).encode())
            n_rows, n_new = n_rows + b - a, n_new + int(new[a:b].sum())
    if at:
        yield row()


def time_partitions(rows: DataFrame, moment: Column, order: list[str], new: Column, limit: int, folder: str, id_col: str) -> DataFrame:
    """Writes the rows of `rows` that aren't new to folder, rewrites it for all of them, and returns one row for each
    file: TimeLayout.files() with rewritten (false: the file stayed from the first layout)."""
    layout = TimeLayout(rows, moment, order, new, limit, folder)
    layout.write()
    stayed = layout.rewrite()
    if not layout.after:
        return rows.sparkSession.createDataFrame([], "leaf string, part long, n_rows long, n_new long, ids_sha256 string, path string, rewritten boolean")
    kept = F.concat_ws(" ", "leaf", "part").isin([f"{x} {p}" for x, p in stayed])
    return layout.files(id_col).withColumn("rewritten", ~kept)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which stays."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def click_moment() -> Column:
    """When a click counts: its ts, for some ids years earlier, for others the start of the week."""
    ts = F.col("ts").cast("timestamp_ntz")
    k = F.crc32(F.col("click_id").cast("string")) % 128
    earlier = ts - F.make_dt_interval(days=((k + 6) * (k + 6) * (k + 6)).cast("int"))
    monday = F.date_sub(F.to_date(ts), F.weekday(F.to_date(ts))).cast("timestamp_ntz")
    return F.when(k < 16, earlier).when(k > 111, monday).otherwise(ts)


def op12_time_partitions(spark, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    late = F.col("arrived_at").cast("timestamp_ntz") >= F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    out = time_partitions(clicks, click_moment(), ["arrived_at", "click_id"], late, 1 + clicks.count() // 650, new_folder(spark, "clicks-by-time"), "click_id")
    return out.select("leaf", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", "part", "n_rows", "n_new", "rewritten")
