"""Token counts by the whole-token shortcut: words that are one vocabulary string are counted, only the rest is merged."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import text_or_empty
from noteforge.session import ship_package

#: The mark that stands for a space in pieces of the vocabulary.
MARK = "▁"
#: Merged words that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 300_000
ROWS_A_BATCH = 1000


def small_batches(spark) -> None:
    """Bounds the rows that go to a Python worker at once, so that long texts fit its memory, and sends it this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))


class WholeTokens(dict):
    """Counts tokens as the library does for whole texts. Keys: words that follow one space or the text's start.

    The vocabulary is proved fit when it is loaded: if no piece has a mark behind another character, no merge crosses
    from a word to the space that follows, so a text's count is the sum over its words, each with the spaces in front.
    A word that the library encodes alone as one token is put down as 1; the others are merged when first met.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [self.model.id_to_piece(i) for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError(f"{path}: a piece has a space behind another character; words can't be counted apart")
        words = [p[1:] for p in plain if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
        ids = self.model.encode(words, num_threads=1)
        self.whole = {w: 1 for w, i in zip(words, ids, strict=True) if len(i) == 1}
        super().__init__(self.whole)
        self.spaced = re.compile(" *[^ ]+| +")

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(self.whole)
        n = self[word] = len(self.model.encode(word, num_threads=1))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        n = 0
        for run in self.spaced.findall(" " + text):
            if run == " ":
                n += 1
            elif run[1] != " ":
                n += self[run[1:]]
            else:
                n += len(self.model.encode(run[1:], num_threads=1))
        return n


@lru_cache(2)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs, in a scan without a shuffle.

    path: a sentencepiece BPE model, on the executors' machines. Tokens are those of the library's encode() of the whole
    text. A null text is empty and has none; repeated rows and null ids stay rows; an empty table gives no rows; very
    long texts are read whole; other columns play no part.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = whole_tokens(path)
        for texts in batches:
            yield pd.Series([model.count(t) for t in texts], dtype="int64")

    text = text_or_empty(docs[text_col])
    out = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_whole_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
