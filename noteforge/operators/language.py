"""A language detector: naive Bayes over character trigrams, counted in tasks and summed, scored where the texts lie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.functions import text as texts
from noteforge.session import ship_package, stored

#: Log probabilities are whole millionths, so that sums do not depend on their order.
SCALE = 1_000_000
#: The languages of a model are columns of its plans.
MOST_LANGUAGES = 200
#: A model of more trigrams than this is joined by a shuffle.
MOST_BROADCAST = 400_000
#: A model of more gains (trigrams times languages) than this is joined too.
MOST_GAINS = 4_000_000
#: Guesses below this probability are none.
LEAST_PROBABILITY = 0.1
#: Characters that a task looks at in one step.
PIECE = 500_000


def decided(rows: DataFrame, text: str) -> DataFrame:
    """rows with lang and confidence, from best, prob and the signs in the text. These are columns of their own, so that
    each text is searched for them once."""
    es, en = texts.indicators(F.col(text))
    lang, conf = texts.language_decision(F.col(text), F.col("best"), F.col("prob"), (F.col("_es"), F.col("_en")))
    return rows.withColumns({"_es": es, "_en": en}).withColumns({"lang": lang, "confidence": conf}).drop("_es", "_en")


def words(text: Column) -> Column:
    """The text's words in lower case with one space around each. Characters beyond the basic plane count as spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[[^\p{L}][\x{10000}-\x{10FFFF}]]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Every three characters in a row of words()."""
    return F.regexp_extract_all(words(text), F.lit("(?s)(?=(...))"), F.lit(1))


def pieces(texts) -> Iterator[slice]:
    """Slices of a batch's texts that hold PIECE characters or one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    yield slice(start, len(texts))


def coded_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each trigram of words(), which lie in the basic plane, as a number of 48 bits, and the index of its text."""
    units = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = units[:-2] << np.uint64(32) | units[1:-1] << np.uint64(16) | units[2:]
    inside = owner[:-2] == owner[2:]
    return codes[inside], owner[:-2][inside]


def gram_code(gram: str) -> int:
    return ord(gram[0]) << 32 | ord(gram[1]) << 16 | ord(gram[2])


def counted_trigrams(known: DataFrame, language: str, text: str) -> DataFrame:
    """lang, gram, c of rows with a known language: counted for each piece of a batch, then summed."""
    ship_package(known.sparkSession)

    def count(batches):
        for b in batches:
            for part in pieces(b["words"]):
                codes, owner = coded_trigrams(list(b["words"][part]))
                names, index = np.unique(b["lang"][part].to_numpy(dtype=object), return_inverse=True)
                for i, name in enumerate(names):
                    found, c = np.unique(codes[index[owner] == i], return_counts=True)
                    grams = [chr(x >> 32) + chr(x >> 16 & 0xFFFF) + chr(x & 0xFFFF) for x in found.tolist()]
                    if grams:
                        yield pd.DataFrame({"lang": name, "gram": pd.Series(grams, dtype=object), "c": c})

    parts = known.select(F.col(language).alias("lang"), words(F.col(text)).alias("words")).mapInPandas(count, "lang string, gram string, c long")
    return parts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class LanguageModel:
    """names: the languages in order. grams: gram, gain, for each language what a trigram adds to unseen. unseen, prior:
    for each language. rows: of grams."""

    names: list[str]
    grams: DataFrame
    unseen: list[int]
    prior: list[int]
    rows: int

    def scores(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, n, score: for each row with a trigram (key tells rows apart), their number and the languages' scores.
        Trigrams of a row are summed where they arise; what is shuffled is a partial sum for each row and task."""
        found = rows.select(F.col(key).alias("_key"), F.explode(trigrams(F.col(text))).alias("gram"))
        grams = F.broadcast(self.grams) if self.rows <= MOST_BROADCAST else self.grams
        sums = [F.coalesce(F.sum(F.col("gain")[i]), F.lit(0)) for i in range(len(self.names))]
        by = found.join(grams, "gram", "left").groupBy("_key").agg(F.count("*").alias("n"), *[s.alias(f"_s{i}") for i, s in enumerate(sums)])
        score = F.array(*[F.col(f"_s{i}") + F.col("n") * self.unseen[i] + self.prior[i] for i in range(len(self.names))])
        return by.select(F.col("_key").alias(key), "n", score.alias("score"))

    def detect(self, rows: DataFrame, key: str, text: str, languages: list[str] | None = None) -> DataFrame:
        """rows with best and prob: of `languages` (default: all) the likeliest, and its probability among all that the
        model knows. Guesses under LEAST_PROBABILITY, and rows without a letter or text, have null and 0. Of equal ones
        the first by name is taken. key: a column that is not null and tells rows apart."""
        top = F.array_max("score")
        weight = lambda i: F.exp((F.col("score")[i] - top) / SCALE)
        whole = sum((weight(i) for i in range(len(self.names))), F.lit(0.0))
        asked = [i for i, n in enumerate(self.names) if languages is None or n in languages]
        guesses = [F.struct((weight(i) / whole).alias("p"), F.lit(-i).alias("i"), F.lit(self.names[i]).alias("name")) for i in asked]
        if not guesses:
            return rows.withColumns({"best": F.lit(None).cast("string"), "prob": F.lit(0.0)})
        best = F.array_max(F.array(*guesses))
        if 0 < self.rows <= MOST_BROADCAST and self.rows * len(self.names) <= MOST_GAINS:
            out = rows.withColumn("score", self.scorer(rows.sparkSession)(words(F.col(text)))).withColumn("_best", best)
            likely = F.col("_best.p") >= LEAST_PROBABILITY
            return out.withColumns({"best": F.when(likely, F.col("_best.name")), "prob": F.when(likely, F.col("_best.p")).otherwise(0.0)}).drop("score", "_best")
        found = self.scores(rows, key, text).select(F.col(key).alias("_key"), best.alias("_best")).where(F.col("_best.p") >= LEAST_PROBABILITY)
        out = rows.join(found, F.col(key) == F.col("_key"), "left")
        return out.withColumns({"best": F.col("_best.name"), "prob": F.coalesce("_best.p", F.lit(0.0))}).drop("_key", "_best")

    def scorer(self, spark: SparkSession):
        """A function of words() that gives a text's score, null without a trigram. The grams and their gains, which are
        few, are broadcast; texts are read where they lie."""
        ship_package(spark)
        names = len(self.names)
        table = self.grams.toPandas()
        codes = np.array([gram_code(g) for g in table["gram"]], dtype=np.uint64)
        order = np.argsort(codes)
        gains = np.array(table["gain"].tolist(), dtype=np.int64).reshape(-1, names)[order]
        known = spark.sparkContext.broadcast((codes[order], gains, np.array(self.unseen, np.int64), np.array(self.prior, np.int64)))

        def score(texts: pd.Series) -> pd.Series:
            codes, gains, unseen, prior = known.value
            out = []
            for part in pieces(texts.fillna("")):
                some = list(texts.fillna("")[part])
                found, owner = coded_trigrams(some)
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                hit = codes[at] == found
                n = np.bincount(owner, minlength=len(some))
                # sums of whole numbers below 2**53: exact
                sums = np.stack([np.bincount(owner[hit], gains[at[hit], i], len(some)) for i in range(names)], 1).astype(np.int64)
                out += [s if k else None for s, k in zip(sums + n[:, None] * unseen + prior, n, strict=True)]
            return pd.Series(out, dtype=object)

        return F.pandas_udf(score, "array<long>")


def fit(rows: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """The model of rows with a known language; nulls teach nothing. Counts are whole-corpus sums by (language, trigram)
    with add-one smoothing over the trigrams met; only the languages come to the driver."""
    known = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    by = stored(counted_trigrams(known, language, text), "trigrams")
    docs = dict(known.groupBy(language).count().limit(MOST_LANGUAGES + 1).collect())
    if len(docs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {language}")
    totals = dict(by.groupBy("lang").agg(F.sum("c")).collect())
    names, distinct = sorted(docs), by.select("gram").distinct().count()
    log = lambda x: int(math.floor(math.log(x) * SCALE + 0.5))
    unseen = [log(1 / (totals.get(n, 0) + distinct)) if distinct else 0 for n in names]
    gains = []
    for i, n in enumerate(names):
        seen = F.max(F.when(F.col("lang") == n, F.col("c")))
        logp = F.floor(F.log((seen + 1) / F.lit(float(totals.get(n, 0) + distinct))) * SCALE + 0.5)
        gains.append(F.coalesce(logp - unseen[i], F.lit(0)).cast("long"))
    grams = by.groupBy("gram").agg(F.array(*gains).alias("gain")) if names else by.select("gram", F.array().cast("array<long>").alias("gain"))
    whole = sum(docs.values())
    return LanguageModel(names, stored(grams, "language-model"), unseen, [log(docs[n] / whole) for n in names], distinct)
