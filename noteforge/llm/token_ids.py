"""Token ids as Parquet list columns, in id order, with bounded row groups and page indexes; selective reads."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.llm.common import new_path, text_or_empty
from noteforge.llm.tokens import small_batches

#: Encoded words that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 250_000
#: The pre-tokens of byte-level vocabularies; a fixed value.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a slim aggregate that cut the id range, and about how many documents go to a file.
FILE_ROWS, MOST_FILES = 8_000, 20_000
#: How the files are written. Dictionary pages suit a vocabulary's few ids; where one grows too large, the second
#: version's writer falls back to delta encoding. Small pages with a column index let a reader skip to few documents.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.dictionary.page.size": str(1 << 20),
}


class WordIds(dict):
    """Ids of whole texts as the library gives them, kept for each word as little-endian unsigned 32-bit integers.

    The pre-tokenizer always starts a new pre-token at a space that another character than white space follows, so the
    stretches between such places are encoded apart. Keys: stretches without that space. A special token's string is cut
    out first, as the library does it.

    Vocabulary and merges are read from the library's file. Where the merges stand in the order of the ids that they
    make, as byte-level vocabularies have it, ids are ranks, and new words are merged by rank with tiktoken's core, which
    is several times faster and gives the same ids; else by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.special = {k: array("I", [i]).tobytes() for k, i in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.start, self.odd = re.compile(r" (?=\S)"), re.compile(r" (?=\s|\Z)")
        ranks = self.ranks(path, set(special))
        if ranks:
            import tiktoken

            self.ids = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.ids = lambda text: self.model.encode(text, add_special_tokens=False).ids

    def ranks(self, path: str, special: set[str]) -> dict[bytes, int] | None:
        """The vocabulary as bytes, if it is byte-level BPE with this pre-tokenizer and its merges are in order."""
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = spec["model"]["vocab"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [vocabulary[x] for x in made]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(made) + 256 != len(vocabulary) - len(special & set(vocabulary)):
            return None
        return {bytes(letters[c] for c in k): i for k, i in vocabulary.items() if k not in special}

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.ids(" " + word)).tobytes()
        return ids

    def plain(self, text: str) -> bytes:
        words = self.start.split(text) if self.odd.search(text) else text.split(" ")
        first = array("I", self.ids(words[0])).tobytes()
        del words[0]
        return first + b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.specials and any(s in text for s in self.special):
            return b"".join(self.special.get(x) or self.plain(x) for x in self.specials.split(text))
        return self.plain(text)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_token_ids(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes doc_id, n_tokens, ids (a list column) of each row of docs to Parquet files in the folder `out`.

    path: a tokenizers file, on the executors' machines. end_id is put behind each document. Files follow each other in
    ascending id (null first), as rows do within them; the range of ids is cut by an approximate histogram of the
    narrow id column, at most MOST_FILES values, then whole rows move once. Null texts are empty and have the end id
    alone; of repeated ids the shorter, then the smaller text comes first; other columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    n = slim.count()
    files = max(8, min(MOST_FILES, -(-n // FILE_ROWS)))
    cuts = slim.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 20 * files).alias("c")).first()["c"] or []
    at = F.size(F.filter(F.lit(sorted(set(cuts)) or [0]), lambda c: c <= F.coalesce("doc_id", F.lit(-(1 << 63)))))
    placed = slim.repartitionById(files, at).sortWithinPartitions("doc_id", F.length("text"), "text")
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        for b in batches:
            ids = [model.encode(t) + end for t in b.column(1).to_pylist()]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], lengths.cumsum()]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lengths), lists], schema=schema)

    placed.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(out)


def read_token_ids(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The files' rows; of columns not asked for no page is read. Filters on doc_id skip row groups and pages."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(folder).select(*columns, F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).alias("part"))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files. start is summed within a file over the narrow
    columns alone and shifted by the files' totals, one number a file."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].astype("<u4")) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(crc, np.int64)), pa.array(np.diff(at).astype(np.int64))], names=["part", "row", "doc_id", "ids_crc32", "n_tokens"])

    small_batches(spark)
    part = F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).alias("part")
    whole = spark.read.schema("doc_id long, ids array<int>").parquet(folder).select(part, F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    rows = whole.mapInArrow(digest, "part string, row long, doc_id long, ids_crc32 long, n_tokens long")
    totals = read_token_ids(spark, folder, ("n_tokens",)).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.coalesce(own, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "token-ids")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_digests(spark, out)
