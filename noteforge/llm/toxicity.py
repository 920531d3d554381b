"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import free_name, text_or_empty
from noteforge.llm.tokens import small_batches

#: Insults, slurs kept out, in the four languages of the corpora; fixed values.
LEXICON = {
    "insult_en": "idiot moron stupid dumb fool imbecile loser clown scum trash garbage pathetic worthless disgusting jerk creep pig scumbag freak filth vermin".split(),
    "insult_de": "idiot dumm dummkopf trottel arschloch abschaum widerlich wertlos erbärmlich versager".split(),
    "insult_fr": "idiot imbécile crétin connard ordure minable dégoûtant abruti stupide salaud".split(),
    "insult_es": "idiota imbécil estúpido basura asqueroso patético inútil perdedor payaso escoria".split(),
    "threat": "kill murder destroy hurt punch strangle".split(),
    "contempt": "hate despise loathe ugly sick shut".split(),
}
#: Voters that look at a text's form. Each reads the lower-cased text.
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are)\s+(?:an?|such an?|so)\b"),
    "shut_up": re.compile(r"\bshut\s+up\b|\bgo\s+to\s+hell\b"),
    "masked": re.compile(r"\b[a-z]+[*@$#]{1,4}[a-z]+\b"),
    "shouting": re.compile(r"!{3,}"),
}
#: Letters that digits and signs stand for in disguised words; fixed values.
DISGUISE = str.maketrans("013457@$", "oieastas")
WORDS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"\b(?=\w*[^\W\d_])(?=[^\s]*[0-9@$])[\w@$]{3,20}")
#: Bounds: labelled rows whose words make the mined voters, and to which label model and classifier are fitted; mined
#: words; voters that share them. The sample is those rows with the smallest hash of the id.
LABELLED_ROWS, MINED_WORDS, MINED_VOTERS, STARTS = 20_000, 240, 12, (5, 7)
MINED_LEAST, MINED_SHARE = 5, 0.8
EPOCHS_EM, STEPS, RIDGE = 30, 25, 0.005


def bucket_of(row_id: Column, parts: int) -> Column:
    return F.crc32(row_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: Column, rows: int) -> DataFrame:
    """text, toxic of at most `rows` labelled rows of docs in the training folds. The chosen ids are broadcast: rows of
    them at most."""
    chosen = labels.where(fold & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def mined_words(sample: DataFrame) -> list[str]:
    """Words, and starts of words with a * behind, that mark the labelled toxic texts: in MINED_LEAST of them at least,
    and MINED_SHARE of the texts with the word are toxic; the MINED_WORDS most frequent of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    starts = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in STARTS]
    counts = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *starts))).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    best = counts.where((F.col("t") >= MINED_LEAST) & (F.col("t") >= MINED_SHARE * F.col("n")) & (F.length("w") > 1))
    return [r["w"] for r in best.orderBy(F.desc("t"), "w").limit(MINED_WORDS).collect()]


class Voters:
    """The features of a text: a flag for each term, then a vote for each voter (lexicons, patterns, mined words)."""

    def __init__(self, mined: list[str]):
        groups = [list(v) for v in LEXICON.values()] + [mined[i::MINED_VOTERS] for i in range(MINED_VOTERS)]
        self.terms = sorted({w for g in groups for w in g})
        at = {w: i for i, w in enumerate(self.terms)}
        self.index, self.groups = at, [[at[w] for w in g] for g in groups if g]
        self.n_terms, self.n_voters = len(self.terms), len(self.groups) + len(PATTERNS)

    def active(self, text: str) -> list[int]:
        low = text.lower()
        words = set(WORDS.findall(low))
        words.update(w.translate(DISGUISE) for w in DISGUISED.findall(low))
        has = {self.index[w] for w in words if w in self.index}
        for n in STARTS:
            has.update(self.index[w] for w in {w[:n] + "*" for w in words if len(w) > n} if w in self.index)
        found = sorted(has)
        votes = [any(t in has for t in g) for g in self.groups] + [bool(p.search(low)) for p in PATTERNS.values()]
        return found + [self.n_terms + i for i, v in enumerate(votes) if v]

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.n_terms + self.n_voters), np.float32)
        for i, r in enumerate(rows):
            out[i, r] = 1
        return out


class LabelModel:
    """P(vote | class) of each voter by expectation maximisation, each row's class the mean of its posterior and its label;
    correlations of voters given the class from what the votes' covariance leaves unexplained half way. From then on a vote's evidence is divided by the
    number of voters that it correlates with, itself included."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray):
        n, m = votes.shape
        self.p = np.vstack([np.full(m, 0.02), np.full(m, 0.25)])
        self.balance, self.share = min(max(float(labels.mean()) if n else 0.1, 0.005), 0.5), np.ones(m)
        for step in range(EPOCHS_EM):
            if step == EPOCHS_EM // 2:
                self.share = 1 / self.correlated(votes, post)
            post = (self.posterior(votes) + labels) / 2
            for c, w in enumerate((1 - post, post)):
                self.p[c] = (w @ votes + (0.02, 0.25)[c]) / (w.sum() + 1)
            self.p = np.clip(self.p, 1e-4, 1 - 1e-4)
        self.accuracy = self.balance * self.p[1] + (1 - self.balance) * (1 - self.p[0])

    def correlated(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        rest = votes - post[:, None] * self.p[1] - (1 - post)[:, None] * self.p[0]
        cov = rest.T @ rest / max(1, len(votes))
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd < 1e-3] = np.inf
        self.correlation = cov / np.outer(sd, sd)
        return np.maximum(1, (self.correlation * (self.correlation > 0.3)).sum(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.p[1] / self.p[0]) * self.share
        no = np.log((1 - self.p[1]) / (1 - self.p[0])) * self.share
        z = np.log(self.balance / (1 - self.balance)) + votes @ yes + (1 - votes) @ no
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps, with a ridge on all weights but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += move * min(1, 4 / max(1e-9, np.abs(move).max()))
    return w[:-1], float(w[-1])


def toxicity_model(docs: DataFrame, labels: DataFrame, fold: Column, rows: int = LABELLED_ROWS):
    """The voters, the label model and the classifier (weights, bias). docs: doc_id, text."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, fold, rows)
    voters = Voters(mined_words(sample))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": [voters.active(t) for t in pdf["text"]], "toxic": pdf["toxic"]})

    got = sample.mapInPandas(features, "a array<int>, toxic int").collect()
    x = voters.matrix([r["a"] for r in got])
    votes = x[:, voters.n_terms :].astype(float)
    model = LabelModel(votes, np.array([float(r["toxic"] > 0) for r in got]))
    w, b = fit_linear(x.astype(float), model.posterior(votes)) if len(got) else (np.append(np.full(voters.n_terms, 3.0), np.zeros(voters.n_voters)), -1.5)
    return voters, model, w, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, rows: int = LABELLED_ROWS, carry_all: bool = False) -> DataFrame:
    """Scores each row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.5).

    labels: doc_id, toxic. Rows whose crc32 of the id as text leaves 0 modulo `folds` are held out: their labels are not
    used. Mined words, label model and classifier are fitted to at most `rows` labelled rows of the other folds; scores
    depend on nothing but the whole text. Null and empty texts get the score of a text without any vote; null ids are
    not held out; without labels the fixed lexicons score alone; an empty table gives no rows; other columns play no
    part. With carry_all the columns of docs are returned and the score under a free name.
    """
    text = text_or_empty(docs[text_col])
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    voters, _, w, b = toxicity_model(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), known, bucket_of(F.col("doc_id"), folds) != 0, rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-min(max(b + sum(w[i] for i in voters.active(t)), -30), 30))) for t in texts], dtype="float64")

    if carry_all:
        return docs.withColumn(free_name(docs, "score"), score(text))
    held = F.coalesce(bucket_of(docs[id_col], folds) == 0, F.lit(False))
    out = docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), score(text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_label_model(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
