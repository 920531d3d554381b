"""Mixing sources to target weights: fixed-length blocks drawn through pseudorandom index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import WORD, free_name, pieces_for, running, stored, text_or_empty, with_row_keys

#: Weights of sources in code-point order, repeating; fixed values.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
ROUNDS = 8


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """A target for each (source, size), in code-point order, null last. The water level: share of all sizes is dealt
    by weight, no source gets more than most times its size, and what is above goes to the others by weight."""
    left, open_, out = share * sum(s for _, s in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        each = left / sum(w[i] for i in open_)
        full = {i for i in open_ if each * w[i] >= most * sizes[i][1]}
        for i in full or open_:
            out[i] = most * sizes[i][1] if full else each * w[i]
            left -= out[i]
        open_ = open_ - full if full else set()
    return out


def permuted(df: DataFrame, x: str, n: Column, seed: Column, rounds: int = ROUNDS) -> DataFrame:
    """Column x, in 0 to n - 1, through a pseudorandom permutation of that range: the swap-or-not shuffle. Each round
    pairs x with its mirror image (k - x) mod n and swaps both or neither, by a bit of a hash of the pair."""
    df = df.withColumn("_n", n).withColumn("_seed", seed)
    mirror = lambda v, r: F.pmod(F.pmod(F.xxhash64("_seed", r), "_n") - v, "_n")
    swap = lambda v, r: F.xxhash64("_seed", r, F.greatest(v, mirror(v, r))) % 2 == 0
    steps = F.aggregate(F.lit(list(range(rounds))), F.col(x).cast("long"), lambda v, r: F.when(swap(v, r), mirror(v, r)).otherwise(v))
    return df.withColumn(x, steps).drop("_n", "_seed")


def repaired(slots: DataFrame, wanted: list[int]) -> DataFrame:
    """slots (s, a source's number; j, a slot's number among those of s) with as many slots of each source as wanted, all
    of them in sum: the slots that a source has too many, its last, go to the sources that lack some, in order."""
    drawn = {r["s"]: r["n"] for r in slots.groupBy("s").agg(F.count("*").alias("n")).collect()}
    over, under, more, less = [], [], 0, 0
    for i, n in enumerate(wanted):
        over.append(more)
        under.append(less)
        more, less = more + max(0, drawn.get(i, 0) - n), less + max(0, n - drawn.get(i, 0))
    pick = lambda values, at: F.element_at(F.lit(values or [0]), at + 1).cast("long")
    rank = F.col("j") - pick(wanted, F.col("s")) + pick(over, F.col("s"))
    out = slots.withColumn("_r", F.when(F.col("j") >= pick(wanted, F.col("s")), rank))
    to = F.size(F.filter(F.lit([u if n > drawn.get(i, 0) else -1 for i, (u, n) in enumerate(zip(under, wanted, strict=True))] or [0]), lambda u: (u >= 0) & (u <= F.col("_r"))))
    lacking = [i for i, n in enumerate(wanted) if n > drawn.get(i, 0)]
    out = out.withColumn("_s", F.element_at(F.lit(lacking or [0]), F.greatest(to, F.lit(1))))
    moved = pick([drawn.get(i, 0) - u for i, u in enumerate(under)], F.col("_s")) + F.col("_r")
    out = out.withColumn("j", F.when(F.col("_r").isNull(), F.col("j")).otherwise(moved)).withColumn("s", F.when(F.col("_r").isNull(), F.col("s")).otherwise(F.col("_s")))
    return out.drop("_r", "_s")


class Mix:
    """A mix of docs: `sources` has the sizes, targets and draws; `slots` each block of the output with its shard and
    the source's block that it holds; `pieces` the documents' words in each block; `taken` the words taken of each row."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, shard_slots: int = 4096, seed: int = 1) -> None:
        spark = docs.sparkSession
        size = F.regexp_count(text_or_empty(F.col(text_col)), F.lit(WORD)).cast("long")
        self.docs, self.keys = with_row_keys(docs)
        slim = self.docs.select(self.docs[id_col].alias("doc_id"), self.docs[source_col].alias("source"), size.alias("size"), *[self.docs[k].alias(n) for k, n in zip(self.keys, ("row_file", "row_at"), strict=True)])
        self.slim = stored(slim.withColumn("rid", F.monotonically_increasing_id()), "sized")
        got = sorted(((r["source"], r["size"], r["n"]) for r in self.slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
        self.sources, self.block, self.shard_slots = [], block, shard_slots
        start, n_rows = 0, sum(n for _, _, n in got)
        for i, ((source, total, _), target) in enumerate(zip(got, targets([(s, z) for s, z, _ in got]), strict=True)):
            blocks = -(-total // block)
            draws = min(int(MOST) * blocks, round(target * blocks / total)) if total else 0
            self.sources.append({"s": i, "source": source, "source_size": total, "target": target, "blocks": blocks, "draws": draws, "start": start})
            start += draws
        self.n_slots = start
        index = F.lit([x["source"] for x in self.sources if x["source"] is not None] or [""])
        at = F.when(F.col("source").isNull(), F.lit(len(self.sources) - 1)).otherwise(F.array_position(index, F.col("source")).cast("int") - 1)
        self.rows = self.slim.withColumn("s", at)
        placed = running(self.rows.where("size > 0"), ["s"], F.xxhash64(F.lit(seed), "doc_id", "row_file", "row_at"), ["row_file", "row_at"], {"size": "first"}, pieces_for(n_rows))
        cut = placed.withColumn("b", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")))
        words = F.expr(f"least(first + size, (b + 1) * {block}) - greatest(first, b * {block})")
        self.pieces = cut.select("rid", "s", "b", words.alias("words"), F.expr(f"greatest(first, b * {block}) - first").alias("skip"))
        starts = F.lit([x["start"] for x in self.sources] or [0])
        slots = spark.range(self.n_slots).withColumnRenamed("id", "slot")
        drawn_at = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.lit(max(1, self.n_slots)))
        slots = slots.withColumn("p", drawn_at).withColumn("s", F.size(F.filter(starts, lambda x: x <= F.col("p"))) - 1)
        slots = stored(slots.select("slot", "s", F.lit(1).cast("long").alias("_one")), "drawn")
        slots = running(slots, ["s"], F.xxhash64(F.lit(seed), "slot"), ["slot"], {"_one": "j"}, pieces_for(self.n_slots)).drop("_one")
        slots = repaired(slots, [x["draws"] for x in self.sources])
        slots = slots.withColumn("nb", F.element_at(F.lit([max(1, x["blocks"]) for x in self.sources] or [1]), F.col("s") + 1).cast("long"))
        slots = slots.withColumns({"epoch": F.expr("j div nb"), "b": F.expr("j % nb")})
        slots = permuted(slots, "b", F.col("nb"), F.xxhash64(F.lit(seed), "s")).select("slot", F.expr(f"slot div {shard_slots}").alias("shard"), "s", "epoch", "b")
        self.slots = stored(slots, "slots")

    def drawn(self) -> DataFrame:
        """Blocks that the mix holds, and how often."""
        return self.slots.groupBy("s", "b").agg(F.count("*").alias("times"))

    def shard_counts(self) -> DataFrame:
        """Blocks of each source in each output shard: multinomial draws, but for the slots that repaired() moves."""
        return self.slots.groupBy("shard", "s").agg(F.count("*").alias("blocks"))

    def taken(self) -> DataFrame:
        """Each row's words in the mix."""
        got = self.pieces.join(self.drawn(), ["s", "b"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        size = F.element_at(F.lit([x["source_size"] for x in self.sources] or [0]), F.col("s") + 1).cast("long")
        target = F.element_at(F.lit([x["target"] for x in self.sources] or [0.0]), F.col("s") + 1).cast("double")
        out = self.rows.withColumns({"source_size": size, "target": target}).join(got, "rid", "left")
        return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("rid", "row_file", "row_at", "s", "source")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Mixes docs to target weights; returns for each row doc_id, size, source_size, target, taken.

    The words of a source, documents in a pseudorandom order, fill blocks of fixed length. The output is a row of slots;
    each slot draws its source by the targets' shares, so a shard's counts are a multinomial draw. By chance a source
    then has a few slots too many or too few, about the square root of its number; those are dealt anew, so that totals
    hold exactly. A source's slots walk through a permutation of its block indexes, again and again: no block is drawn
    more than ceil(draws / blocks) times, two at most.

    Documents without words take no part (taken 0); null is a source like others, the last; null texts are empty; null
    and repeated ids are rows of their own; an empty table gives no rows; other columns play no part. Sources are
    metadata: their table is held by the driver. Nothing else is collected.
    """
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents: a row for each pass over a row of docs that takes words of it, with all columns. The text is
    the whole text where the pass takes all of its words, else the words taken, joined by blanks; chars_col, where docs
    has it, is its length. Rows without words leave the mix. Whole rows are read again by their keys."""
    mix = Mix(docs, id_col, text_col, source_col, **options)
    docs, columns, (file, at) = mix.docs, docs.columns, mix.keys
    got, whole = (free_name(docs, x) for x in ("got", "whole"))
    part = F.struct("skip", "words")
    passes = mix.pieces.join(mix.slots.select("s", "b", "epoch"), ["s", "b"]).groupBy("rid", "epoch").agg(F.sort_array(F.collect_list(part)).alias(got), F.sum("words").alias(whole))
    passes = passes.join(mix.slim.where("size > 0").select("rid", "size", "row_file", "row_at"), "rid")
    passes = passes.select(F.col("row_file").alias(file), F.col("row_at").alias(at), got, (F.col(whole) == F.col("size")).alias(whole))
    rows = docs.join(passes, [file, at])
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform(got, lambda p: F.slice(words, (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " ")
    rows = rows.withColumn(text_col, F.when(F.col(whole), F.col(text_col)).otherwise(some))
    if chars_col in columns:
        rows = rows.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return rows.select(*columns)


def op9_mix_blocks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
