"""Near-duplicates by MinHash: banded candidates, odd sketches to estimate their similarity, full sets to confirm it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import BROADCAST_BYTES, join_groups, stored, text_or_empty, with_row_keys, without_rows
from noteforge.llm.tokens import small_batches

#: BANDS x BAND_ROWS MinHash samples. At a similarity of 0.8 a pair shares no band with a chance of 2e-7.
BANDS, BAND_ROWS = 30, 4
SAMPLES = BANDS * BAND_ROWS
#: Words of 64 bits of an odd sketch. A pair passes whose XOR has at most MOST_ODD ones; at a similarity of 0.8, 24 of
#: 120 samples differ on average (standard deviation 4.4) and turn 2 bits each, which gives 44 ones (deviation 7.8).
SKETCH_WORDS = 8
MOST_ODD = 80
#: Links of one document that a task confirms together.
CHUNK = 500
#: Shingles and samples are mixed by these; fixed values, the odd constants of a well-known 64-bit finaliser.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; of all words as one, if they are fewer; none without."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(MIX[2]) + h[i : len(h) - k + 1 + i] + np.uint64(k))
    return np.unique(out)


@lru_cache(1)
def sample_seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(MIX[2]))
    return x[:SAMPLES] | np.uint64(1), x[SAMPLES:]


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minima under multiply-add hashing modulo 2 ** 64."""
    a, b = sample_seeds()
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * a + b).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample turns the bit that it hashes to: what two sketches share cancels in their XOR."""
    at = mix64(samples * np.uint64(MIX[2]) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(64 * SKETCH_WORDS)
    bits = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def signatures(docs: DataFrame, text: Column, words: int, carry: dict[str, Column]) -> DataFrame:
    """carry, n_shingles, digest (two longs of the whole set), sketch and a long for each band; no lists for empty sets."""
    small_batches(docs.sparkSession)
    names = list(carry)
    types = dict(docs.select(*[c.alias(n) for n, c in carry.items()]).dtypes)
    ddl = ", ".join(f"{n} {types[n]}" for n in names) + ", n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>"

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, d1, d2, sketches, bands = [], [], [], [], []
            for t in pdf.pop("_text"):
                s = shingle_set(t, words)
                n.append(len(s))
                if not len(s):
                    d1.append(0), d2.append(0), sketches.append(None), bands.append(None)
                    continue
                place = np.arange(1, len(s) + 1, dtype=np.uint64)
                d1.append(int(mix64(s * np.uint64(MIX[0]) + place).sum().view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix64(s * np.uint64(MIX[1]) + place)).view(np.int64)))
                m = min_hashes(s)
                sketches.append(odd_sketch(m))
                key = np.arange(BANDS, dtype=np.uint64)
                for i in range(BAND_ROWS):
                    key = mix64(key * np.uint64(MIX[2]) + m[i::BAND_ROWS])
                bands.append(key.view(np.int64))
            yield pdf.assign(n_shingles=n, d1=d1, d2=d2, sketch=sketches, bands=bands)

    return docs.select(*[c.alias(n) for n, c in carry.items()], text.alias("_text")).mapInPandas(sign, ddl)


def odd_bits(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_WORDS)))


def settled(links: DataFrame) -> bool:
    """Whether links (a, b) are stars: each a has one b, and no b is an a."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return links.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for ids that are not their component's smallest.
    Alternates large stars and small stars until only stars are left; each round is a shuffle of the links, written to
    the shared folder. The many links of a star's centre are spread by join_groups."""
    smaller = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stored(smaller(links), "links")
    while not settled(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = join_groups(both.where("b > a"), least, "a", "n", 2 * links.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(smaller(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))), "stars")
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_groups(down, low, "a", "n", down.count()).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        links = stored(smaller(small), "links")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets meet 100 * intersection >= 80 * union. texts: id, text. The links
    of one a are cut into chunks of about CHUNK; its text goes to each chunk once, the text of b to each link."""
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("links"))
    heads = sizes.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (links - 1) div {CHUNK})"))).drop("links")
    heads = heads.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    tails = join_groups(pairs, sizes, "a", "links", n).withColumn("chunk", F.expr(f"pmod(xxhash64(b), (links - 1) div {CHUNK} + 1)")).drop("links")
    tails = tails.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                if x not in known:
                    known = {x: shingle_set(x, words)}
                s, t = known[x], shingle_set(y, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield pd.Series(out, dtype=bool)

    return tails.join(heads, ["a", "chunk"]).sortWithinPartitions("a", "chunk").where(linked("text_a", "text_b")).select("a", "b")


def close_pairs(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a band and that sizes and odd sketches do not rule out. info: id, n, sketch, bands."""
    other = info.select(F.col("id").alias("b"), F.col("n").alias("o_n"), F.col("sketch").alias("o_sketch"), F.col("bands").alias("o_bands"))
    both = pairs.join(info.withColumnRenamed("id", "a"), "a").join(other, "b")
    return both.where(F.expr("5 * least(n, o_n) >= 4 * greatest(n, o_n)") & (odd_bits("sketch", "o_sketch") <= MOST_ODD) & F.arrays_overlap("bands", "o_bands")).select("a", "b")


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """id, n (size of the set), shingles (hashes) of each of texts: id, text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "shingles": sets})

    return texts.select("id", "text").mapInPandas(cut, "id long, n long, shingles array<long>")


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(token, id, n, at): the shingles that stand at the front of each set of sets (id, n, shingles) when it is sorted
    by how many of the sets have a shingle, the rarest first. Two sets of a similarity of 0.8 have a common shingle among
    the first n - ceil(0.8 n) + 1 of each; at is its place, from 0. Shingles of one set alone take places, but no row."""
    each = sets.select("id", "n", F.explode("shingles").alias("token"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uses = stored(each.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1"), "uses")
    shared = join_groups(each, uses, "token", "uses", total).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("front"))
    shared = shared.withColumn("own", F.col("n") - F.size("front")).withColumn("most", F.expr("cast(n - (4 * n + 4) div 5 + 1 - own as int)"))
    front = shared.where("most > 0").select("id", "n", "own", F.posexplode(F.expr("slice(front, 1, most)")).alias("place", "f"))
    return front.select("f.token", "id", "n", (F.col("own") + F.col("place")).alias("at"))


def in_components(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def central_pairs(lists: DataFrame, total: int) -> DataFrame:
    """Each member of a token's list with the list's centre: the one with the fewest rarer shingles in front, for its
    size. In a group of near copies that is the one with the fewest changes of its own, which most others are close to."""
    centre = F.min(F.struct((F.col("at") / F.col("n")).alias("share"), F.xxhash64("id").alias("h"), "id")).alias("c")
    heads = lists.groupBy("token").agg(centre, F.count("*").alias("members")).where("members > 1").select("token", F.col("c.id").alias("o_id"), "members")
    return ordered(join_groups(lists, heads, "token", "members", total).where("id <> o_id"))


def open_pairs(lists: DataFrame, total: int, info: DataFrame) -> DataFrame:
    """The pairs of different components in a token's list whose places leave a similarity of 0.8 possible and whose odd
    sketches (info: id, sketch) don't rule it out; both is tested inside the join, so that documents which share a
    passage and little else make no rows. Members outside the list's largest component are compared with all: between
    two components one side is always such."""
    sizes = lists.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token")
    most = sizes.agg(F.max(F.struct("c", F.col("component").alias("main"))).alias("m"), F.sum("c").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mixed = join_groups(lists, most.select("token", "m.main", "members"), "token", "members", total).drop("members")
    mixed = stored(mixed.join(info.select("id", "sketch"), "id"), "mixed")
    few = mixed.where("component <> main").drop("main")
    many = mixed.select(*[F.col(c).alias(f"o_{c}") for c in ("token", "id", "n", "at", "component", "sketch")])
    possible = F.expr("9 * least(n - at, o_n - o_at) >= 4 * (n + o_n) and 5 * least(n, o_n) >= 4 * greatest(n, o_n)")
    return ordered(few.join(many, [F.col("token") == F.col("o_token"), F.col("component") != F.col("o_component"), possible, odd_bits("sketch", "o_sketch") <= MOST_ODD]))


def near_links(classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(id, component) of classes that are linked with a smaller one. classes: id, n, sketch, bands;
    texts: id, text of those that share a band with another.

    Within the banded candidates, lists of rare shingles in common (see prefix_lists) find the pairs to look at: first
    each member of a list with its centre, then, in lists that still hold several components, the pairs whose places
    allow a link. Odd sketches discard pairs; full sets confirm the rest. No link of a banded pair is lost."""
    sets = stored(shingle_rows(texts, words), "sets")
    lists = stored(prefix_lists(sets), "lists")
    total = lists.count()
    info = classes.join(lists.select("id").distinct(), "id", "left_semi")
    tried = stored(close_pairs(central_pairs(lists, total), info), "pairs")
    parts = components(stored(confirmed(tried, texts, words), "found"))
    rest = close_pairs(open_pairs(in_components(lists, parts), total, info), info).join(tried, ["a", "b"], "left_anti")
    more = stored(confirmed(rest, texts, words), "found")
    return parts if more.isEmpty() else components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_groups(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, and with keys (names of with_row_keys) them.

    A document's set: distinct shingles of `words` words, A-Z lower-cased; with fewer words all as one; null, empty and
    blank texts have none and are linked with nothing. Documents are linked where 100 * intersection >= 80 * union;
    component_id is the smallest id that links reach (null ids rank last), kept marks it (of repeated ids, one row).
    An empty table gives no rows; other columns play no part.

    Documents of one set are one class from the start. Classes that share one of BANDS bands of MinHash samples are
    candidates; near_links finds and confirms their links, so a group of thousands of near copies takes a few comparisons
    a member. Nothing is collected on the driver but counts. Each row is read by its key, and class numbers are written
    down once, so a lost executor changes nothing.
    """
    small_batches(docs.sparkSession)
    if keys is None:
        docs, own = with_row_keys(docs)
    else:
        own = keys
    carry = {"doc_id": docs[id_col], "row_file": docs[own[0]], "row_at": docs[own[1]]}
    sets = stored(signatures(docs, text_or_empty(docs[text_col]), words, carry), "signatures")
    some = sets.where("n_shingles > 0").withColumn("set", F.struct("n_shingles", "d1", "d2"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_at", "sketch", "bands")
    classes = some.groupBy("set").agg(F.min(order).alias("r"), F.count("*").alias("copies"))
    classes = stored(classes.select("set", "r.*", "copies", F.monotonically_increasing_id().alias("id")), "classes")
    n_classes, n_some = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    near = join_groups(buckets, full, "bucket", "members", BANDS * n_classes).select("id").distinct()
    near = stored(near.join(classes.select("id", F.col("row_file").alias(own[0]), F.col("row_at").alias(own[1])), "id"), "near")
    mine = docs.select(*own, text_or_empty(docs[text_col]).alias("text"))
    texts = stored(mine.join(F.broadcast(near) if near.count() * 64 <= BROADCAST_BYTES else near, own).select("id", "text"), "texts")
    parts = near_links(classes.select("id", F.col("set.n_shingles").alias("n"), "sketch", "bands"), texts, words)
    whole = classes.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = whole.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "row_file", "row_at")).alias("least"), F.count("*").alias("members"))
    named = join_groups(whole.select("component", "set", "copies"), least, "component", "members", n_classes)
    named = named.select("set", "copies", F.col("least.doc_id").alias("component_id"), F.struct("least.row_file", "least.row_at").alias("keeper"))
    linked = join_groups(some, named, "set", "copies", n_some).withColumn("kept", F.struct("row_file", "row_at") == F.col("keeper"))
    alone = sets.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    names = ["doc_id", "n_shingles", "component_id", "kept"]
    out = linked.select("row_file", "row_at", *names).unionByName(alone.select("row_file", "row_at", *names))
    return out.select(*names) if keys is None else out.select(F.col("row_file").alias(keys[0]), F.col("row_at").alias(keys[1]), *names)


def drop_near(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups doesn't keep; all columns."""
    docs, keys = with_row_keys(docs)
    return without_rows(docs, near_groups(docs, words, id_col, text_col, keys).where("not kept"), keys)


def op3_odd_sketches(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
