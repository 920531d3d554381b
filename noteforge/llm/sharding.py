"""Histogram sort: shards of near equal bytes, each a range of a sort key."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.llm.common import small_table, stored, text_or_empty, with_row_keys

KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 12, 6
#: Ranges of a shard in which its rows are numbered, at most; the driver sees 2 ** NEXT_BITS counts of each.
MOST_CUTS = 512


def shard_key(text, *row):
    """63 bits: the CRC of the text, so that equal texts stand together, then a hash of the row's id and place, so that
    they can be split, repeated rows too."""
    return F.shiftleft(F.crc32(F.encode(text, "utf-8")), 31).bitwiseOR(F.xxhash64(*row).bitwiseAND(F.lit((1 << 31) - 1)))


def find_splitters(slim: DataFrame, n: int, tolerance: float, key: str = "key", size: str = "size") -> list[int]:
    """n - 1 keys that cut slim into n ranges of near equal bytes. Each round counts the exact bytes in front of probe
    keys across all partitions: first at every FIRST_BITS-bit prefix, then only within the cells that still hold a
    splitter, each cut into 2 ** NEXT_BITS. A splitter is done when its cell holds at most tolerance of a range's bytes,
    one row, or one key. The driver sees 2 ** FIRST_BITS, then at most n * 2 ** NEXT_BITS counts a round."""
    shift = KEY_BITS - FIRST_BITS
    cells = slim.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size).alias("b"), F.count("*").alias("c")).collect()
    cells = sorted((r["cell"], r["b"], r["c"]) for r in cells)
    total = sum(b for _, b, _ in cells)
    fine_enough = tolerance * total / n
    found: dict[int, int] = {}

    def settle(cells: list[tuple[int, int, int]], start: int, wanted: list[int]) -> dict[int, tuple[int, list[int]]]:
        """Cells to cut further, with the bytes in front of them and the splitters inside."""
        open_cells: dict[int, tuple[int, list[int]]] = {}
        edges, at = [start], start
        for _, b, _ in cells:
            at += b
            edges.append(at)
        for i in wanted:
            target = total * i // n
            k = min(max(bisect.bisect_right(edges, target) - 1, 0), len(cells) - 1)
            cell, b, c = cells[k]
            if b <= fine_enough or c <= 1 or shift == 0:
                low = target - edges[k] <= edges[k + 1] - target
                found[i] = cell << shift if low else (cell + 1) << shift
            else:
                open_cells.setdefault(cell, (edges[k], []))[1].append(i)
        return open_cells

    todo = settle(cells, 0, list(range(1, n))) if cells else {}
    while todo:
        before, shift = shift, max(shift - NEXT_BITS, 0)
        probe = slim.where(F.shiftright(key, before).isin(*todo))
        counts = probe.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size).alias("b"), F.count("*").alias("c")).collect()
        inside: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted((r["cell"], r["b"], r["c"]) for r in counts):
            inside.setdefault(r[0] >> (before - shift), []).append(r)
        again: dict[int, tuple[int, list[int]]] = {}
        for cell, (start, wanted) in todo.items():
            again |= settle(inside[cell], start, wanted)
        todo = again
    keys = [found[i] for i in sorted(found)]
    return [max(keys[: i + 1]) for i in range(len(keys))]


def histogram_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, range_rows: int = 100_000) -> DataFrame:
    """Deals docs into n_shards shards of near equal bytes by histogram sort.

    Size of a row: UTF-8 bytes of the text plus 16. The rows are ordered by a 63-bit key made of the text's CRC and a
    hash of the id and the row's place; a shard is a range of keys, so equal texts are neighbours and only a group on a
    shard's border is cut. Bytes of shards differ by the tolerance or by one row. The key ranges are several times finer
    than the shards, by the number of rows, so that a range holds about `range_rows` up to MOST_CUTS ranges a shard: rows
    move once, by fine range, and are numbered there from the counts in front of the range.

    Returns id, size, text_crc32, key, shard, slot (gapless from 0 within a shard). Null texts count as empty; null ids
    are one id like others; repeated rows (id and text) are rows of their own; an empty table gives no rows;
    other columns, whatever their names, play no part. Many long texts only change the sums.
    """
    spark = docs.sparkSession
    docs, keys = with_row_keys(docs)
    text, row_id = text_or_empty(docs[text_col]), docs[id_col]
    slim = stored(docs.select(row_id.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), shard_key(text, row_id, *[docs[k] for k in keys]).alias("key")), "shards")
    cuts = min(MOST_CUTS, max(8, -(-slim.count() // (n_shards * range_rows))))
    splitters = find_splitters(slim, n_shards * cuts, tolerance)
    shift = KEY_BITS - FIRST_BITS
    by_cell: dict[int, list[int]] = {}
    for s in splitters:
        by_cell.setdefault(s >> shift, []).append(s)
    rows, seen = [], 0
    for cell in range(1 << FIRST_BITS):
        rows.append({"cell": cell, "base": seen, "cut": by_cell.get(cell, [])})
        seen += len(by_cell.get(cell, []))
    cells = small_table(spark, rows, "cell bigint, base int, cut array<bigint>")
    placed = slim.join(F.broadcast(cells), F.shiftright(slim["key"], shift) == cells["cell"])
    placed = placed.withColumn("fine", F.expr("base + size(filter(cut, c -> c <= key))")).drop("cell", "base", "cut")
    counts = {r["fine"]: r["n"] for r in placed.groupBy("fine").agg(F.count("*").alias("n")).collect()}
    starts = []
    for i in range(n_shards * cuts):
        starts.append(0 if i % cuts == 0 else starts[-1] + counts.get(i - 1, 0))
    offset = F.element_at(F.lit(starts), F.col("fine") + 1).cast("long")
    number = F.row_number().over(W.partitionBy("fine").orderBy("key", "doc_id", "text_crc32", "size"))
    return placed.withColumn("slot", offset + number - 1).withColumn("shard", F.floor(F.col("fine") / cuts).cast("int")).drop("fine")


def op1_histogram_shards(spark, sf_dir: str) -> DataFrame:
    shards = histogram_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
