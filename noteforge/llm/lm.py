"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation, state kept across windows."""

from __future__ import annotations

import contextlib
import ctypes
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import stored, text_or_empty
from noteforge.llm.tokens import small_batches

#: Words with an output of their own: CLASSES x PER_CLASS less one, the end; one class more holds all rarer words.
CLASSES, PER_CLASS, HIDDEN = 64, 64, 16
VOCABULARY = CLASSES * PER_CLASS
#: Most frequent words whose exact counts every worker holds; counts of the others are joined by a shuffle.
HEAD_WORDS = 200_000
#: Training: each document is learned whole in one of the rounds; WINDOW steps are backpropagated at a time.
WINDOW, ROUNDS, LANES, RATE = 32, 2, 128, 0.1
#: Words that a worker gathers before it deals documents to lanes; for scoring, lanes and steps whose outputs it holds.
GATHER, SCORE_LANES, SCORE_WINDOW = 4_000_000, 384, 64
#: Tokens whose class outputs are made at once, so that they stay in a core's cache.
AT_ONCE, ONES = 2048, np.ones(max(CLASSES + 1, PER_CLASS), np.float32)
#: Pieces in which the workers' parameters are added up.
PIECES = 1024
#: Up to so many tokens of a window have their class's weights gathered one by one; more are sorted by class.
FEW = 256
#: Distinct words that a worker counts before it passes them on.
COUNTED = 400_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOG10 = float(np.log(10))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def keep_memory() -> None:
    """Lets the C library keep freed memory, where it is glibc: arrays of a window come and go, and new pages are dear."""
    with contextlib.suppress(OSError, AttributeError):
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(option, 64 << 20)


class Gru:
    """h' = (1 - z) n + z h. Inputs give the gates' sums directly; the output is P(class | h) P(word | class, h). Word i
    of the vocabulary is number i // CLASSES of class i % CLASSES; VOCABULARY stands for all rarer words."""

    SHAPES = {"x": (VOCABULARY + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES + 1), "cb": (CLASSES + 1,), "w": (CLASSES, HIDDEN, PER_CLASS), "wb": (CLASSES, PER_CLASS)}

    def __init__(self, flat: np.ndarray):
        self.p, at = {}, 0
        flat = np.array(flat, np.float32)
        for k, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.p[k], at = flat[at : at + n].reshape(shape), at + n
        self.squares: dict[str, np.ndarray] = {}

    @classmethod
    def fresh(cls, counts: np.ndarray, rare: float, seed: int = 1) -> Gru:
        """Starts as the unigram model of the counts of the vocabulary and of all rarer words."""
        rng = np.random.default_rng(seed)
        model = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        each = np.zeros(VOCABULARY) + 0.1
        each[: len(counts)] += counts
        table = each.reshape(PER_CLASS, CLASSES).T
        model.p["x"][:] = rng.normal(0, 0.3, cls.SHAPES["x"])
        model.p["u"][:] = rng.normal(0, 0.3, cls.SHAPES["u"])
        shares = np.append(table.sum(1), rare + 0.1)
        model.p["cb"][:] = np.log(shares / shares.sum())
        model.p["wb"][:] = np.log(table / table.sum(1, keepdims=True))
        return model

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def run(self, h: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The steps of a window (steps x lanes): the states in front of each token, the state behind the last, and for
        each step the gates z and r, the new state n and what r is applied to."""
        x, k, fresh, u = self.p["x"][tokens], 2 * HIDDEN, starts.any(1), self.p["u"]
        before, gates, new, inner = (np.empty((*tokens.shape, n), np.float32) for n in (HIDDEN, k, HIDDEN, HIDDEN))
        for t in range(len(tokens)):
            if fresh[t]:
                h = np.where(starts[t][:, None], np.float32(0), h)
            before[t] = h
            g, zr, n = h @ u, gates[t], new[t]
            np.add(x[t, :, :k], g[:, :k], out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            inner[t] = g[:, k:]
            np.multiply(zr[:, HIDDEN:], g[:, k:], out=n)
            n += x[t, :, k:]
            np.tanh(n, out=n)
            h = h - n
            h *= zr[:, :HIDDEN]
            h += n
        return before, h, gates[:, :, :HIDDEN], gates[:, :, HIDDEN:], new, inner

    def of_classes(self, h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Log probabilities of the classes, and of all classes the exponentials and their sums."""
        e = h @ self.p["c"]
        e += self.p["cb"]  # small: states are within 1, biases start as log shares
        logp = e[np.arange(len(classes)), classes]
        np.exp(e, out=e)
        total = e @ ONES[: CLASSES + 1]
        return logp - np.log(total), e, total

    def outputs(self, h: np.ndarray, tokens: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of tokens from the states in front; with grad, adds the gradients of their sum and
        returns that by h."""
        classes = np.where(tokens == VOCABULARY, CLASSES, tokens % CLASSES)
        if grad is None and len(tokens) > 2 * AT_ONCE:
            logp = np.concatenate([self.of_classes(h[i : i + AT_ONCE], classes[i : i + AT_ONCE])[0] for i in range(0, len(tokens), AT_ONCE)])
        else:
            logp, e, total = self.of_classes(h, classes)
        dh = None
        if grad is not None:
            e *= (-1 / total)[:, None]
            e[np.arange(len(tokens)), classes] += 1
            grad["c"] += h.T @ e
            grad["cb"] += e.sum(0)
            dh = e @ self.p["c"].T
        if len(tokens) <= FEW:
            at = np.flatnonzero(classes < CLASSES)
            at = at[np.argsort(classes[at], kind="stable")]
            c, word, k = classes[at], tokens[at] // CLASSES, np.arange(len(at))
            s = (h[at, None, :] @ self.p["w"][c])[:, 0] + self.p["wb"][c]
            chosen = s[k, word]
            np.exp(s, out=s)
            total = s.sum(1)
            logp[at] += chosen - np.log(total)
            if grad is not None and len(at):
                s *= (-1 / total)[:, None]
                s[k, word] += 1
                edges = np.flatnonzero(np.diff(c, prepend=-1))
                grad["w"][c[edges]] += np.add.reduceat(h[at][:, :, None] * s[:, None, :], edges, axis=0)
                grad["wb"][c[edges]] += np.add.reduceat(s, edges, axis=0)
                dh[at] += (self.p["w"][c] @ s[:, :, None])[:, :, 0]
            return logp, dh
        order = np.argsort(classes, kind="stable")[: np.count_nonzero(classes < CLASSES)]
        more, dhs = self.of_words(h[order], classes[order], tokens[order] // CLASSES, grad)
        logp[order] += more
        if grad is not None:
            dh[order] += dhs
        return logp, dh

    def of_words(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray, grad: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of words within their classes, for tokens in the order of classes, and with grad the
        gradients as outputs gives them. Only the products go class by class; biases are a last row of the weights."""
        n, table = len(h), np.concatenate((self.p["w"], self.p["wb"][:, None]), 1)
        hs = np.concatenate((h, np.ones((n, 1), np.float32)), 1)
        logp, dh = np.empty(n, np.float32), None if grad is None else np.empty_like(h)
        summed = None if grad is None else np.zeros_like(table)
        for at in range(0, n, AT_ONCE):
            part = slice(at, at + AT_ONCE)
            own, hp = classes[part], hs[part]
            edges = np.flatnonzero(np.diff(own, prepend=-1))
            spans = [(c, slice(i, j)) for c, i, j in zip(own[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True)]
            s = np.empty((len(own), PER_CLASS), np.float32)
            for c, k in spans:
                np.matmul(hp[k], table[c], out=s[k])
            places = np.arange(0, s.size, PER_CLASS) + words[part]
            chosen = s.ravel()[places]
            np.exp(s, out=s)
            total = s @ ONES[:PER_CLASS]
            logp[part] = chosen - np.log(total)
            if grad is not None:
                s *= (-1 / total)[:, None]
                s.ravel()[places] += 1
                dp = dh[part]
                for c, k in spans:
                    summed[c] += hp[k].T @ s[k]
                    np.matmul(s[k], self.p["w"][c].T, out=dp[k])
        if grad is not None:
            grad["w"] += summed[:, :HIDDEN]
            grad["wb"] += summed[:, HIDDEN]
        return logp, dh

    def learn(self, h: np.ndarray, tokens: np.ndarray, starts: np.ndarray, valid: np.ndarray, full: int = 0) -> np.ndarray:
        """One step of truncated backpropagation through a window; returns the state behind it. The gradient is the mean
        over the window's tokens, or with full its sum over that many, so that a window of few lanes weighs less."""
        grad = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items() if k != "x"}
        before, h, z, r, n, inner = self.run(h, tokens, starts)
        flat = np.flatnonzero(valid.ravel())
        dh_out = np.zeros((tokens.size, HIDDEN), np.float32)
        _, dh_out[flat] = self.outputs(before.reshape(-1, HIDDEN)[flat], tokens.ravel()[flat], grad)
        dh_out = dh_out.reshape(before.shape)
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), inner * r * (1 - r)
        dh, fresh, k, u = np.zeros_like(h), starts.any(1), 2 * HIDDEN, self.p["u"].T.copy()
        dn, dg = np.empty_like(before), np.empty((*tokens.shape, 3 * HIDDEN), np.float32)
        for t in range(len(tokens) - 1, -1, -1):
            da, d = dn[t], dg[t]
            np.multiply(dh, by_n[t], out=da)
            np.multiply(dh, by_z[t], out=d[:, :HIDDEN])
            np.multiply(da, by_r[t], out=d[:, HIDDEN:k])
            np.multiply(da, r[t], out=d[:, k:])
            dh *= z[t]
            dh += d @ u
            dh += dh_out[t]
            if fresh[t]:
                dh[starts[t]] = 0
        grad["u"] += before.reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
        dx = dg
        dx[:, :, k:] = dn
        order = np.argsort(tokens.ravel(), kind="stable")
        seen, edges = np.unique(tokens.ravel()[order], return_index=True)
        grad["x"] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], edges, axis=0)
        scale = np.float32(1 / max(1, full or len(flat)))
        for k, d in grad.items():
            d *= scale
            if k not in self.squares:
                self.squares[k] = np.full(self.SHAPES[k], 1e-6, np.float32)
            s = self.squares[k]
            of = seen if k == "x" else slice(None)  # inputs that a window lacks have no gradient
            s[of] += d * d
            d *= np.float32(RATE)
            self.p[k][of] += d / np.sqrt(s[of])
        return h


def deal(lists: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to lanes, the longest first, each to the lane that is free first. Returns steps x lanes of
    tokens, of flags of first tokens, and of document numbers (-1: padding)."""
    lanes = max(1, min(lanes, len(lists)))
    heap = [(0, i) for i in range(lanes)]
    places = []
    for d in sorted(range(len(lists)), key=lambda i: -len(lists[i])):
        at, lane = heapq.heappop(heap)
        places.append((d, lane, at))
        heapq.heappush(heap, (at + len(lists[d]), lane))
    steps = max(at for at, _ in heap)
    tokens, starts, owner = np.zeros((lanes, steps), np.int32), np.zeros((lanes, steps), bool), np.full((lanes, steps), -1, np.int32)
    for d, lane, at in places:
        end = at + len(lists[d])
        tokens[lane, at:end], owner[lane, at:end], starts[lane, at] = lists[d], d, True
    return np.ascontiguousarray(tokens.T), np.ascontiguousarray(starts.T), np.ascontiguousarray(owner.T)


def score_lists(model: Gru, lists: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each document."""
    tokens, starts, owner = deal(lists, SCORE_LANES)
    out = np.zeros(len(lists))
    order = np.argsort(-(owner >= 0).sum(0), kind="stable")  # lanes that end first stand last and are cut off
    tokens, starts, owner = tokens[:, order], starts[:, order], owner[:, order]
    h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
    for at in range(0, len(tokens), SCORE_WINDOW):
        part = slice(at, at + SCORE_WINDOW)
        n = int((owner[at] >= 0).sum())
        own = owner[part, :n].ravel()
        before, h = model.run(h[:n], tokens[part, :n], starts[part, :n])[:2]
        real = np.flatnonzero(own >= 0)
        logp, _ = model.outputs(before.reshape(-1, HIDDEN)[real], tokens[part, :n].ravel()[real])
        out += np.bincount(own[real], weights=logp, minlength=len(lists))
    return out


def token_ids(head: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of words (-1: not in head), and tokens of the model with the end behind: 0 is the end, rank r is r + 1."""
    ranks = np.fromiter(map(head.get, words, repeat(-1)), np.int32, len(words))
    tokens = np.zeros(len(words) + 1, np.int32)
    tokens[:-1] = np.where((ranks < 0) | (ranks >= VOCABULARY - 1), VOCABULARY, ranks + 1)
    return ranks, tokens


def packed(tokens: np.ndarray) -> bytes:
    """Tokens as stored: VOCABULARY and what lies below fit into two bytes each."""
    return tokens.astype("<u2").tobytes()


def unpacked(tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, "<u2").astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, count) over all texts; each worker adds up before words are shuffled."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(words_of(t))
                if len(seen) > COUNTED:
                    yield pd.DataFrame({"word": list(seen), "count": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "count": list(seen.values())})

    return texts.select("text").mapInPandas(count, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """(word, count) of the most frequent words, `most` at most, in order: those above the least count that leaves so few.
    Counts that occur are few: so many different ones need a corpus of half their square."""
    by = counts.groupBy("count").agg(F.count("*").alias("n")).toArrow().sort_by([("count", "descending")])
    fits = np.cumsum(by["n"].to_numpy()) <= most
    least = int(by["count"].to_numpy()[fits].min()) if fits.any() else 1 << 62
    return counts.where(F.col("count") >= least).toArrow().sort_by([("count", "descending"), ("word", "ascending")])


def learn_tokens(model: Gru, lists: Iterator[np.ndarray]) -> int:
    """Trains the model on every token of the documents; returns their number."""
    n, held, gathered = 0, [], 0
    for x in lists:
        held.append(x)
        gathered += len(x)
        if gathered >= GATHER:
            n += walk(model, held)
            held, gathered = [], 0
    return n + (walk(model, held) if held else 0)


def learn_texts(model: Gru, texts: Iterator[str], head: dict[bytes, int]) -> int:
    """learn_tokens on every word and end of the texts."""
    return learn_tokens(model, (token_ids(head, words_of(t))[1] for t in texts))


def trained(docs: DataFrame, model: Gru, rounds: int) -> Gru:
    """Each task trains a copy on whole documents of its partition, those that h deals to the round; the copies' mean,
    weighted by tokens, is summed up by a shuffle and starts the next round. After the last, every token has been learned
    once. docs: tokens (see packed), h (a hash of the id)."""
    for turn in range(rounds):
        start = model.flat()

        def learn(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            keep_memory()
            own = Gru(start)
            n = learn_tokens(own, (unpacked(x) for pdf in batches for x in pdf["tokens"]))
            if n:
                yield pd.DataFrame({"piece": range(PIECES), "n": [n] * PIECES, "p": np.array_split(own.flat() * n, PIECES)})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"piece": pdf["piece"][:1], "p": [np.sum(pdf["p"].tolist(), axis=0, dtype=float) / pdf["n"].sum()]})

        got = docs.where(F.col("h") % rounds == turn).select("tokens").mapInPandas(learn, "piece int, n long, p array<float>")
        got = got.groupBy("piece").applyInPandas(add, "piece int, p array<double>").toArrow().sort_by("piece")
        if got.num_rows:
            model = Gru(got["p"].combine_chunks().values.to_numpy())
    return model


def walk(model: Gru, lists: list[np.ndarray]) -> int:
    """Learns documents from their first token to their end, WINDOW steps at a time; states run on across windows."""
    tokens, starts, owner = deal(lists, LANES)
    order = np.argsort(-(owner >= 0).sum(0), kind="stable")  # lanes that end first stand last and are cut off
    tokens, starts, owner = tokens[:, order], starts[:, order], owner[:, order]
    h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
    for at in range(0, len(tokens), WINDOW):
        part, n = slice(at, at + WINDOW), int((owner[at] >= 0).sum())
        h = model.learn(h[:n], tokens[part, :n], starts[part, :n], owner[part, :n] >= 0, WINDOW * tokens.shape[1])
    return int((owner >= 0).sum())


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Tokens: words of the text, A-Z lower-cased, and one end. Counts are exact over all rows that held_out leaves for
    training; base_score adds one to each. score is the log10 probability of the whole text under the recurrent model:
    its state runs from the first word to the end across windows of steps. The VOCABULARY most frequent words are
    outputs of their own; a rarer word has the probability of the class of rare words times its share of that class,
    one added. The model learns every training document whole, once, in one of `rounds` rounds.

    Null, empty and blank texts are the end alone; repeated rows and null ids are rows of their own; with no training
    rows all counts are 0; an empty table gives no rows; other columns play no part. A worker holds HEAD_WORDS counts;
    rarer words are joined with theirs by a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(held_out, F.lit(False))
    texts = docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), text_or_empty(docs[text_col]).alias("text"))
    train = texts.where("not held_out")
    counts = stored(word_counts(train), "words")
    n_words, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    total, kinds = n_words + ends, distinct + (ends > 0)
    top = frequent(counts, HEAD_WORDS)
    times = np.append(ends, top["count"].to_numpy())[: VOCABULARY].astype(float)
    rare_n, rare_kinds = total - times.sum(), max(0, kinds - len(times))
    rare_log = float(np.log10(rare_n + rare_kinds + 1))
    ranked = top["word"].to_pylist()
    # Every text is encoded once; training and scoring read its tokens, two bytes each.
    head = spark.sparkContext.broadcast((dict(zip(ranked, range(len(ranked)), strict=True)), np.log10(top["count"].to_numpy() + 1.0)))
    end_log = float(np.log10(ends + 1))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks_of, logs = head.value
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                words = words_of(t)
                ranks, tokens = token_ids(ranks_of, words)
                tail = [words[j] for j in np.flatnonzero(ranks < 0)]
                rare = logs[ranks[ranks >= VOCABULARY - 1]]
                rows.append((packed(tokens), len(tokens), float(logs[ranks[ranks >= 0]].sum()) + end_log, tail, float(rare.sum()) - rare_log * (len(rare) + len(tail))))
            made = pd.DataFrame(rows, columns=["tokens", "n_tokens", "head_log", "tail", "rare"])
            yield pd.concat([pdf[["rid", "doc_id", "held_out", "h"]].reset_index(drop=True), made], axis=1)

    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string"), "held_out", dealt.alias("h"), "text")
    encoded = numbered.mapInPandas(encode, "rid long, doc_id string, held_out boolean, h long, tokens binary, n_tokens long, head_log double, tail array<binary>, rare double")
    encoded = stored(encoded.withColumn("doc_id", F.col("doc_id").cast("long")), "encoded")
    model = trained(encoded.where("not held_out").select("tokens", "h"), Gru.fresh(times, rare_n), rounds)
    weights = spark.sparkContext.broadcast(model.flat())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_memory()
        own, rids, lists, gathered = Gru(weights.value), [], [], 0
        for pdf in batches:
            rids.extend(pdf["rid"])
            lists.extend(map(unpacked, pdf["tokens"]))
            gathered += int(pdf["n_tokens"].sum())
            if gathered >= GATHER:
                yield pd.DataFrame({"rid": rids, "logp": score_lists(own, lists) / LOG10})
                rids, lists, gathered = [], [], 0
        if lists:
            yield pd.DataFrame({"rid": rids, "logp": score_lists(own, lists) / LOG10})

    logps = encoded.select("rid", "tokens", "n_tokens").mapInPandas(score, "rid long, logp double")
    scored = encoded.drop("tokens", "h")
    tail = scored.select("rid", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.log10(F.coalesce("count", F.lit(0)) + 1)).alias("tail_log"), F.count_if(F.col("count").isNull()).alias("unknown"))
    done = scored.drop("tail").join(logps, "rid").join(tail, "rid", "left")
    tail_log, unknown = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("unknown", F.lit(0)) + (0 if ends else 1)
    base = F.col("head_log") + tail_log - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("n_tokens") - unknown).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logp") + F.col("rare") + tail_log).alias("score"))


def op8_gru(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2)
