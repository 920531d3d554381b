"""Chroma fingerprints of recordings: pitch-class frames, integral-image filters, packed integers, aligned by offsets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import join_groups, new_path, stored
from noteforge.llm.tokens import small_batches

#: Samples a second of headerless media, samples of a frame and between frames, frames that are transformed at once.
RATE, FRAME, HOP, AT_ONCE = 4000, 512, 64, 4096
PITCHES, LOWEST, HIGHEST = 12, 110.0, 1760.0
#: Frames under the widest filter, and the filters: kind, first pitch class, pitch classes, frames. Each compares two
#: parts of a rectangle: by kind its lower and upper half, its earlier and later half, the diagonal quarters, the
#: middle third of its pitches and the rest, or of its frames. Its log ratio in units of STEP gives two bits.
WIDTH, STEP, GRAIN = 8, 0.08, 24
FILTERS = [(kind, low, tall, wide) for kind, low, tall, wide in (
    (0, 0, 12, 4), (0, 0, 6, 8), (0, 6, 6, 8), (0, 3, 6, 4), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 0, 12, 8),
    (2, 0, 6, 8), (2, 6, 6, 8), (2, 0, 12, 4), (3, 0, 12, 4), (3, 0, 6, 8), (3, 6, 6, 8), (4, 0, 6, 6), (4, 6, 6, 6),
)]
#: At most this share of the bits differs in the overlap of an alignment, by the items of the overlap, see most_error().
#: From the gap that was measured: of all pairs in 10,000 recordings and all shifts, unrelated ones have at least 0.055
#: over 4 items, 0.087 over 5, 0.099 over 6, 0.119 over 8 to 15, 0.15 over 16 and more; one changed byte gives up to
#: 0.057, a cut by half a hop up to 0.086, both by queries in two phases.
MOST_ERROR, MOST_ERROR_SHORT, SURE, LEAST = 0.125, 0.1, 8, 16
#: Items of the queries that a worker holds at once, and pairs of equal items that it looks at together.
BLOCK_ITEMS, AT_A_TIME = 4_000_000, 1_000_000
#: Samples under the widest filter. A recording of fewer than LEAST items is heard with silence on both sides, so long
#: that each frame still holds a hop of it: its beginning and its end make items too.
SHORTEST = FRAME + (WIDTH - 1) * HOP
SHORT, SILENCE = SHORTEST + (LEAST - 1) * HOP, FRAME - HOP


def decode_pcm(media: bytes) -> np.ndarray:
    """Samples from -1 to 1, mono. RIFF WAVE of 8 or 16 bits, or else headerless 8-bit samples. A broken header, or one
    without samples, is read as headerless."""
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        at, channels, bits = 12, 1, 8
        while at + 8 <= len(media):
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"fmt " and at + 24 <= len(media):
                channels, bits = struct.unpack_from("<H", media, at + 10)[0], struct.unpack_from("<H", media, at + 22)[0]
            elif name == b"data" and bits in (8, 16) and channels:
                body = media[at + 8 : at + 8 + size]
                body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
                x = np.frombuffer(body, "<i2") / 32768 if bits == 16 else (np.frombuffer(body, np.uint8) - 128.0) / 128
                return x.reshape(-1, channels).mean(1)
            at += 8 + size + size % 2
    return (np.frombuffer(media, np.uint8) - 128.0) / 128


@lru_cache(1)
def pitch_map() -> tuple[np.ndarray, slice, np.ndarray]:
    """The window, the bins of the spectrum that are used, and which pitch class each of them adds to."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    inside = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    out = np.zeros((len(inside), PITCHES))
    out[np.arange(len(inside)), np.round(12 * np.log2(hz[inside] / 440)).astype(int) % PITCHES] = 1
    return np.hanning(FRAME), slice(inside[0], inside[-1] + 1), out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of each pitch class in each frame, as shares of the frame's."""
    window, used, mapped = pitch_map()
    if len(samples) < FRAME:
        return np.empty((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for i in range(0, len(frames), AT_ONCE):
        part = frames[i : i + AT_ONCE]
        spectrum = np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1)[:, used]
        out.append((spectrum.real**2 + spectrum.imag**2) @ mapped)
    c = np.vstack(out)
    return c / np.maximum(c.sum(1, keepdims=True), 1e-6)


def fingerprint_batch(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """For each recording a 32-bit integer for each frame that WIDTH frames start from: two Gray-coded bits of each
    filter. The recordings' frames stand behind each other under one integral image; windows that reach over an end are
    left out. Shares are whole numbers of 2 ** -GRAIN, so that sums are exact whatever stands in front."""
    frames = [chroma(x) for x in recordings]
    lengths = [len(x) for x in frames]
    c = np.rint(np.vstack(frames) * (1 << GRAIN)).astype(np.int64) if frames else np.empty((0, PITCHES), np.int64)
    n = max(0, len(c) - WIDTH + 1)
    whole = np.zeros((len(c) + 1, PITCHES + 1), np.int64)
    whole[1:, 1:] = c.cumsum(0).cumsum(1)
    whole = np.ascontiguousarray(whole.T)

    def area(t: int, wide: int, low: int, tall: int) -> np.ndarray:
        high, base = whole[low + tall], whole[low]
        return (high[t + wide : t + wide + n] - high[t : t + n]) - (base[t + wide : t + wide + n] - base[t : t + n])

    out = np.zeros(n, np.uint32)
    for kind, low, tall, wide in FILTERS:
        everything, scale = area(0, wide, low, tall), 1.0
        if kind == 0:
            part = area(0, wide, low, tall // 2)
        elif kind == 1:
            part = area(0, wide // 2, low, tall)
        elif kind == 2:
            part = area(0, wide // 2, low, tall // 2) + area(wide // 2, wide - wide // 2, low + tall // 2, tall - tall // 2)
        elif kind == 3:
            part, scale = area(0, wide, low + tall // 3, tall // 3), 1.5
        else:
            part, scale = area(wide // 3, wide // 3, low, tall), 1.5
        least, part = 1e-3 * (1 << GRAIN), scale * part
        ratio = (least + part) / (least + np.maximum(everything - part, 0))
        code = (ratio > np.exp(-STEP)).astype(np.uint32) + (ratio > 1) + (ratio > np.exp(STEP))
        out = (out << np.uint32(2)) | (code ^ (code >> 1)).astype(np.uint32)
    starts = np.cumsum([0, *lengths])
    return [out[i : i + max(0, k - WIDTH + 1)].view(np.int32) for i, k in zip(starts[:-1], lengths, strict=True)]


def padded(samples: np.ndarray) -> np.ndarray:
    """Samples of a recording; a SHORT one, less its mean, in the middle of SILENCE, of SHORTEST samples at least."""
    if not 0 < len(samples) < SHORT:
        return samples
    front = max(SILENCE, (SHORTEST - len(samples) + 1) // 2)
    return np.pad(samples - samples.mean(), front)


def most_error(overlap: np.ndarray) -> np.ndarray:
    """The share of bits that may differ over so many items: fewer items tell less, one has to be equal."""
    return np.where(overlap >= LEAST, MOST_ERROR, MOST_ERROR_SHORT * np.minimum(1, overlap / SURE) ** 1.5)


def least_overlap(k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The items in which recordings of k and m items must overlap: half the shorter one's, and LEAST or three quarters
    of it. One of less than 4 items is too short to be found in another: that must be as short."""
    short = np.minimum(k, m)
    need = np.maximum(-(-short // 2), np.minimum(LEAST, -(-3 * short // 4)))
    return np.where((short < 4) & (np.maximum(k, m) > short + 1), np.maximum(k, m) + 1, need)


def fingerprints(media: DataFrame, content: Column, row_id: Column, query: Column | None = None) -> DataFrame:
    """doc_id, items of each recording, n_items: those of whole windows, without silence; null and empty content has no
    items. query: rows that also get `half`, the items that begin half a hop later."""
    small_batches(media.sparkSession)

    @F.pandas_udf("items array<int>, n_items int, half array<int>")
    def prints(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for b, asked in batches:
            heard = [decode_pcm(bytes(x) if x is not None else b"") for x in b]
            lengths, heard = [len(x) for x in heard], [padded(x) for x in heard]
            half = iter(fingerprint_batch([x[HOP // 2 :] for x, q in zip(heard, asked, strict=True) if q]))
            whole = [max(0, (n - SHORTEST) // HOP + 1) for n in lengths]
            yield pd.DataFrame({"items": fingerprint_batch(heard), "n_items": whole, "half": [next(half) if q else np.empty(0, np.int32) for q in asked]})

    asked = F.coalesce(query, F.lit(False)) if query is not None else F.lit(False)
    return media.select(row_id.cast("long").alias("doc_id"), prints(content, asked).alias("p")).select("doc_id", "p.items", "p.n_items", "p.half")


class Queries:
    """The items of a block of queries, ordered by value, so that equal items of recordings are found by bisection. An id
    may have several lists of items, of its phases."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.lengths = np.array(ids, np.int64), np.array([len(x) for x in items], np.int64)
        self.starts = np.concatenate([[0], self.lengths.cumsum()])
        self.flat = np.concatenate([np.empty(0, np.int32), *items]).astype(np.int32)
        self.order = np.argsort(self.flat, kind="stable")
        self.values = self.flat[self.order]
        self.owner = np.repeat(np.arange(len(ids)), self.lengths)[self.order]
        self.place = self.order - self.starts[self.owner]

    def offsets(self, flat: np.ndarray, owner: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """The offset histogram: (recording, query, shift) at which they have equal items and overlap enough, and how
        many. Equal items are looked at AT_A_TIME pairs together; the counts of such parts are added up."""
        low, high = np.searchsorted(self.values, flat, "left"), np.searchsorted(self.values, flat, "right")
        ends, found = np.cumsum(high - low), []
        at = 0
        while at < len(flat):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, "right")))
            n = high[at:to] - low[at:to]
            mine = np.repeat(np.arange(at, to), n)
            theirs = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low[at:to], n)
            r, q, shift = owner[mine], self.owner[theirs], place[mine] - self.place[theirs]
            k, m = lengths[r], self.lengths[q]
            enough = np.minimum(k, m + shift) - np.maximum(0, shift) >= least_overlap(k, m)
            found.append(np.unique(np.stack([r[enough], q[enough], shift[enough]]), axis=1, return_counts=True))
            at = to
        if not found:
            return (np.empty(0, np.int64),) * 4
        keys, counts = np.concatenate([k for k, _ in found], axis=1), np.concatenate([c for _, c in found])
        keys, of = np.unique(keys, axis=1, return_inverse=True)
        return *keys, np.bincount(of.ravel(), weights=counts, minlength=keys.shape[1]).astype(np.int64)

    def search(self, recordings: list[np.ndarray]) -> list[tuple]:
        """(recording, query id, shift, overlap, bit error, equal items) of each pair that aligns: its shift of at most
        most_error() with the most equal items, then the smallest, then of the least error."""
        lengths = np.array([len(x) for x in recordings], np.int64)
        starts = np.concatenate([[0], lengths.cumsum()])
        flat = np.concatenate([np.empty(0, np.int32), *recordings]).astype(np.int32)
        owner = np.repeat(np.arange(len(recordings)), lengths)
        r, q, shift, votes = self.offsets(flat, owner, np.arange(len(flat)) - starts[owner], lengths)
        start = np.maximum(0, shift)
        overlap = np.minimum(lengths[r], self.lengths[q] + shift) - start
        wrong, ends, at = np.zeros(len(r), np.int64), overlap.cumsum(), 0
        while at < len(r):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, "right")))
            n = overlap[at:to]
            step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            x = flat[np.repeat(starts[r[at:to]] + start[at:to], n) + step] ^ self.flat[np.repeat(self.starts[q[at:to]] + start[at:to] - shift[at:to], n) + step]
            wrong[at:to] = np.add.reduceat(np.bitwise_count(x.view(np.uint32)).astype(np.int64), n.cumsum() - n)
            at = to
        good = np.flatnonzero(wrong <= most_error(overlap) * 32 * overlap)
        of = self.ids[q]
        good = good[np.lexsort((wrong[good] / overlap[good], shift[good], -votes[good], of[good], r[good]))]
        first = np.ones(len(good), bool)
        first[1:] = (r[good][1:] != r[good][:-1]) | (of[good][1:] != of[good][:-1])
        return [(int(r[i]), int(of[i]), int(shift[i]), int(overlap[i]), float(wrong[i] / (32 * overlap[i])), int(votes[i])) for i in good[first]]


def found_by(sounds: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, match_id, shift, overlap, bit_error, votes) of each of sounds (id, items) and each query that it aligns with.
    asked (match_id, items) goes to the workers in blocks of about BLOCK_ITEMS items; all sounds are read once for each
    block and nothing is shuffled."""
    spark = sounds.sparkSession
    path, ddl = new_path(spark, "aligned"), "id long, match_id long, shift int, overlap int, bit_error double, votes long"
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] // BLOCK_ITEMS))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("match_id"), F.lit(blocks)) == block).toArrow()
        queries = spark.sparkContext.broadcast((rows["match_id"].to_pylist(), [x.values.to_numpy() for x in rows["items"]]))

        def search(batches: Iterator[pd.DataFrame], queries=queries) -> Iterator[pd.DataFrame]:
            index = Queries(*queries.value)
            for pdf in batches:
                ids = pdf["id"].to_numpy()
                yield pd.DataFrame([(ids[r], *rest) for r, *rest in index.search(list(pdf["items"]))], columns=["id", "match_id", "shift", "overlap", "bit_error", "votes"])

        sounds.select("id", "items").mapInPandas(search, ddl).write.mode("append").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def align(media: DataFrame, content: Column, row_id: Column, every: int = 50) -> DataFrame:
    """Aligns every recording with the queries, those whose id is divisible by `every`. Returns for each row doc_id,
    n_items, fingerprint (a hash of the items), match_id, shift, overlap, bit_error, matches.

    Recordings of the same items are one sound, named by its fingerprint; a sound that holds queries is asked once, as
    its smallest id, in two phases: as it is, and from half a hop on, so that no cut lies more than a quarter of a hop
    beside one of them. An offset histogram counts the equal items of a recording and a query at each shift; every shift
    with one at least and enough overlap (least_overlap()) is compared bit by bit. bit_error is the share of bits that
    differ where both overlap; a shift with at most most_error() is an alignment, and a pair has the one with the most
    equal items (then the smallest shift). matches lists every query that aligns, by id, as structs of match_id, shift,
    overlap and bit_error; the columns of those names hold the match with the most equal items (then the smallest query)
    or are null. shift counts whole hops. Other queries of a match's sound have its fingerprint and align alike.

    A short recording is heard in silence, see padded(), and compared like any other; the fewer items overlap, the fewer
    bits may differ, and where one item is all there is it must be equal. n_items counts the items of whole windows and
    is 0 below SHORTEST samples. Null and empty media have no items and no match; repeated rows are rows of their own; a
    null id is no query and aligns like others; an empty table gives no rows; other columns play no part.
    """
    query = F.col("doc_id") % every == 0
    prints = stored(fingerprints(media, content, row_id, row_id.cast("long") % every == 0), "prints")
    prints = prints.withColumn("fingerprint", F.xxhash64("items", F.lit(7)))
    prints = prints.withColumn("sound", F.struct("fingerprint", F.hash("items").alias("more"), F.size("items").alias("size")))
    some = prints.where("size(items) > 0")
    asks = F.min(F.when(query, F.struct("doc_id", "half")))
    sounds = some.groupBy("sound").agg(asks.alias("asked"), F.first("items").alias("items"), F.count("*").alias("copies"))
    sounds = stored(sounds.select("sound", "copies", "items", F.col("asked.doc_id").alias("match_id"), F.col("asked.half").alias("half"), F.monotonically_increasing_id().alias("id")), "sounds")
    asked = sounds.where("match_id is not null")
    asked = asked.select("match_id", "items").unionByName(asked.select("match_id", F.col("half").alias("items")).where("size(items) > 0"))
    found = found_by(sounds, asked)
    of = ["match_id", "shift", "overlap", "bit_error"]
    found = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*of))).alias("matches"), F.min(F.struct((-F.col("votes")).alias("rank"), *of)).alias("best"))
    found = found.select("id", *[f"best.{c}" for c in of], "matches")
    named = sounds.select("id", "sound", "copies").join(found, "id", "left").drop("id")
    out = join_groups(some, named, "sound", "copies", some.count())
    names = ["doc_id", "n_items", "fingerprint", *of, F.coalesce("matches", F.array()).alias("matches")]
    none = prints.where("size(items) = 0").withColumns({"match_id": F.lit(None).cast("long"), "shift": F.lit(None).cast("int"), "overlap": F.lit(None).cast("int"), "bit_error": F.lit(None).cast("double"), "matches": F.lit(None).cast(out.schema["matches"].dataType)})
    return out.select(*names).unionByName(none.select(*names))


def op4_chroma_align(spark, sf_dir: str) -> DataFrame:
    """The bytes of each text, heard as 8-bit samples: the test tables hold no other media."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, F.encode(docs["text"], "utf-8"), docs["doc_id"], 50)
