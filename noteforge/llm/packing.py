"""Packing by optimal length buckets: boundaries by dynamic programming, token-budget batches inside each bucket."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import WORD, free_name, pieces_for, running, stored, text_or_empty, with_row_keys

def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries, at most `buckets` of the sorted lengths, that minimise the padding when each row is padded to the
    next boundary. Dynamic programming over the histogram: the best cost of the first j cells in k buckets is the least
    over i of that of i cells in k - 1 buckets, plus length j times the rows from i to j. The best i never falls as j
    grows, so each round halves the ranges that are left, all middles of a level at once."""
    m = len(lengths)
    if m <= buckets:
        return list(lengths)
    size, rows = np.array(lengths, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    cost, back = np.concatenate([[0], size * rows[1:]]), np.zeros((buckets, m + 1), np.int64)
    for k in range(1, buckets):
        new, todo = np.zeros(m + 1, np.int64), [(1, m, 0, m - 1)]
        while todo:
            later = []
            for first, last, low, high in todo:
                j = (first + last) // 2
                i = np.arange(low, min(high, j - 1) + 1)
                options = cost[i] + size[j - 1] * (rows[j] - rows[i])
                best = int(options.argmin())
                new[j], back[k, j] = options[best], low + best
                later += [x for x in ((first, j - 1, low, low + best), (j + 1, last, low + best, high)) if x[0] <= x[1]]
            todo = later
        cost = new
    out, j, k = [], m, buckets - 1
    while j > 0:
        out.append(int(lengths[j - 1]))
        j, k = int(back[k, j]) if k else 0, k - 1
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text", carry_all: bool = False) -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch, slot, batch_rows of each row of docs.

    Length: words of the text, null and empty ones 0. The histogram covers all rows and has a cell for each length, as
    many as the longest text has words at most; the driver holds it, and dynamic programming picks the bucket lengths
    with the least padding. In a bucket the rows, in a pseudorandom order, fill batches of as many rows as fit
    the budget of tokens at the bucket's length, one at least: a longer document is a batch of its own. Batches are
    numbered from 0 in their bucket, slots in their batch. Rows of length 0 are packed like others, into the first
    bucket. Null and repeated ids are rows of their own; an empty table gives no rows. With carry_all the columns of docs
    are returned too and names that clash get underscores; rows are read again by their keys.
    """
    docs, keys = with_row_keys(docs)
    text = text_or_empty(docs[text_col])
    length = F.regexp_count(text, F.lit(WORD)).cast("long")
    slim = stored(docs.select(docs[id_col].alias("doc_id"), length.alias("length"), docs[keys[0]].alias("row_file"), docs[keys[1]].alias("row_at")), "lengths")
    hist = sorted((r["length"], r["n"]) for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds = best_boundaries([t for t, _ in hist], [n for _, n in hist], buckets)
    each = [max(1, budget // max(1, b)) for b in bounds]
    before = [n for _, n in hist]
    rows = [sum(n for (t, _), n in zip(hist, before, strict=True) if bisect.bisect_left(bounds, t) == i) for i in range(len(bounds))]
    table = F.lit(bounds or [0])
    placed = slim.withColumn("bucket", F.size(F.filter(table, lambda b: b < F.col("length"))))
    pick = lambda values: F.element_at(F.lit(values or [1]), F.col("bucket") + 1).cast("long")
    ranked = running(placed.withColumn("_one", F.lit(1).cast("long")), ["bucket"], F.xxhash64("doc_id", "row_file", "row_at"), ["row_file", "row_at"], {"_one": "rank"}, pieces_for(sum(before)))
    ranked = ranked.withColumns({"bucket_length": pick(bounds), "_each": pick(each)})
    ranked = ranked.withColumns({"batch": F.expr("rank div _each"), "slot": F.expr("rank % _each")})
    ranked = ranked.withColumn("batch_rows", F.least(F.col("_each"), pick(rows) - F.col("batch") * F.col("_each")))
    names = ["length", "bucket", "bucket_length", "batch", "slot", "batch_rows"]
    if not carry_all:
        return ranked.select("doc_id", *names)
    more = ranked.select(F.col("row_file").alias(keys[0]), F.col("row_at").alias(keys[1]), *[F.col(n).alias(free_name(docs, n)) for n in names])
    return docs.join(more, keys).drop(*keys)


def op7_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
