"""Exact deduplication: two passes of Bloom filtering, then an exact comparison of the few rows that may repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import BROADCAST_BYTES, join_groups, stored, text_or_empty, with_row_keys, without_rows

#: Rows for each page of the filter, about. A page has 2 ** 32 bits and is kept sparse.
PAGE_ROWS = 4096
#: A bound for the bytes of a 64-bit word of the filter in a broadcast table, hash map included.
WORD_BYTES = 64
#: Hashes of more than this share of the rows are found by counting, not by the filter.
HOT = 1 / 512


def without_space(text: Column) -> Column:
    """The text without every character of [\\x20\\x09-\\x0D]."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def place_of(key: str, n: int) -> tuple[Column, Column]:
    """The page that a hash belongs to and the bit that it sets there, from -2 ** 31, in a filter for n rows."""
    pages = 1 << (max(n, 1) // PAGE_ROWS).bit_length()
    return F.col(key).bitwiseAND(F.lit(pages - 1)), F.shiftright(key, 32).cast("int")


def word_of(page: str, bit: str) -> Column:
    return F.expr(f"{page} * {1 << 26} + (cast({bit} as long) + {1 << 31}) div 64")


def mask_of(bit: str) -> Column:
    return F.expr(f"shiftleft(1L, cast((cast({bit} as long) + {1 << 31}) % 64 as int))")


def repeated_filter(hashes: DataFrame, n: int, hot: list[int], key: str = "h") -> DataFrame:
    """First pass: a Bloom filter of one probe, and of it the bits that more than one row sets, as (word, bits) of 64-bit
    words, none empty. Each task sends its part of a page as a sparse bitmap, four bytes for each row; pages are merged
    apart from each other. Rows of the hashes in hot, of which a page would hold too many, stay out."""
    page, bit = place_of(key, n)
    rest = hashes.where(~F.col(key).isin(hot)) if hot else hashes
    pages = rest.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.array_sort(F.collect_list("bit")).alias("set"))
    twice = pages.select("page", F.explode(F.array_distinct(F.expr("filter(set, (b, i) -> i > 0 and b = set[i - 1])"))).alias("bit"))
    return twice.groupBy(word_of("page", "bit").alias("word")).agg(F.bit_or(mask_of("bit")).alias("bits"))


def maybe_repeated(rows: DataFrame, n: int, key: str = "h") -> DataFrame:
    """Second pass: adds maybe, true for every row whose hash occurs twice and for few others. The filter's words go to
    the rows, as many at once as fit BROADCAST_BYTES; where there are more, the rows are written in slices of words and
    each slice gets its own. So no row moves for the test, whatever its size. Hashes of more than HOT of the rows are
    counted out first: Spark's frequent-item sketch names at most 1 / HOT candidates or little more."""
    hot = [h for h in rows.stat.freqItems([key], HOT).first()[0] if h is not None] if n else []
    hot = [r[0] for r in rows.where(F.col(key).isin(hot)).groupBy(key).count().where(F.col("count") > max(1, n * HOT)).collect()] if hot else []
    words = stored(repeated_filter(rows, n, hot, key), "filter").withColumnRenamed("word", "_word")
    page, bit = place_of(key, n)
    placed = rows.withColumns({"_page": page, "_bit": bit}).withColumn("_word", word_of("_page", "_bit"))
    slices = max(1, -(-words.count() * WORD_BYTES // BROADCAST_BYTES))
    if slices == 1:
        out = placed.join(F.broadcast(words), "_word", "left")
    else:
        of = F.pmod(F.xxhash64("_word"), F.lit(slices)).cast("int")
        placed = stored(placed.withColumn("_slice", of), "slices", "_slice")
        each = [placed.where(F.col("_slice") == i).join(F.broadcast(words.where(of == i)), "_word", "left") for i in range(slices)]
        out = reduce(DataFrame.unionByName, each).drop("_slice")
    known = F.coalesce(F.col("bits").bitwiseAND(mask_of("_bit")) != 0, F.lit(False))
    return out.withColumn("maybe", known | F.col(key).isin(hot) if hot else known).drop("_page", "_bit", "_word", "bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, text_sha256, keep_id, group_size, kept, and with keys (names of
    with_row_keys) them.

    Texts are equal when the same after white space is deleted; null is empty, and all empty texts are one group. Of a
    group the row with the most code points, then the smallest id (null last) stays; of rows that tie in both, exactly
    one. The text is read once; what is hashed goes to the shared folder. Only rows that the filter holds possible are
    shuffled, as hashes and ids; groups above a share of all rows are not shuffled either. An empty table gives no rows;
    other columns play no part.
    """
    docs, own = with_row_keys(docs) if keys is None else (docs, keys)
    text = text_or_empty(docs[text_col])
    slim = docs.select(docs[id_col].alias("doc_id"), docs[own[0]].alias("row_file"), docs[own[1]].alias("row_at"), F.sha2(F.encode(without_space(text), "utf-8"), 256).alias("text_sha256"), F.char_length(text).alias("len"))
    slim = stored(slim.select("doc_id", "row_file", "row_at", F.unhex("text_sha256").alias("sha"), "len", F.xxhash64("text_sha256").alias("h")), "hashed")
    n = slim.count()
    rows = maybe_repeated(slim, n).drop("h")
    first = F.struct((-F.col("len")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_at")
    groups = rows.where("maybe").groupBy("sha").agg(F.min(first).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.struct("best.row_file", "best.row_at").alias("keeper"))
    single = rows.where("not maybe").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id"), "keeper": F.struct("row_file", "row_at")})
    out = single.unionByName(join_groups(rows.where("maybe"), groups, "sha", "group_size", n))
    kept = (F.struct("row_file", "row_at") == F.col("keeper")).alias("kept")
    names = ["doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256")]
    return out.select(*names) if keys is None else out.select(F.col("row_file").alias(keys[0]), F.col("row_at").alias(keys[1]), *names)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay under exact_groups, with all their columns. Whole rows move only where the keys of the
    rows that go do not fit a broadcast."""
    docs, keys = with_row_keys(docs)
    return without_rows(docs, exact_groups(docs, id_col, text_col, keys).where("not kept"), keys)


def op2_exact_bloom(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_OP2 = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS len
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
