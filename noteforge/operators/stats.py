"""Statistics of files: sizes by type, top-k, name n-grams and name patterns, conversations, percentiles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge import vocab
from noteforge.operators import ranks


def size_columns(size: Column) -> list[Column]:
    return [F.count("*").alias("files"), F.sum(size).alias("total_size"), F.avg(size).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size")]


def stats_overall(files: DataFrame) -> DataFrame:
    """One row: count, total and mean of sizes, 0 for an empty table."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"))


def stats_by_type(files: DataFrame) -> DataFrame:
    """Per type: count, sum, mean, extremes and exact median of sizes, and the share of all bytes in percent. The share's
    window runs over the types alone; for the median see ranks."""
    by = files.groupBy("type").agg(*size_columns(F.col("size")))
    middle = ranks.medians(files, ["type"], "size", "median_size").withColumnRenamed("type", "_type")
    by = by.join(middle, F.col("type").eqNullSafe(F.col("_type")), "left").drop("_type")
    total = F.sum("total_size").over(W.partitionBy())
    return by.withColumn("share", F.coalesce(F.try_divide(F.lit(100.0) * F.col("total_size"), total), F.lit(0.0)))


def stats_with_total(files: DataFrame) -> DataFrame:
    """Counts and bytes by type, and in all (type null), from one rollup."""
    return files.rollup("type").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"), F.grouping("type").cast("int").alias("is_total"))


def largest(files: DataFrame, n: int, tie: str) -> DataFrame:
    """The n largest files; ties by `tie`. A top-k per partition, then of those."""
    return files.orderBy(F.desc("size"), tie).limit(n)


def stats_of_largest(files: DataFrame, n: int, tie: str) -> DataFrame:
    """stats_by_type of the n largest files, with their share of the whole vault's bytes in percent."""
    vault = files.agg(F.sum("size").alias("vault"))
    return stats_by_type(largest(files, n, tie)).crossJoin(F.broadcast(vault)).withColumn("vault_share", F.lit(100.0) * F.col("total_size") / F.col("vault")).drop("vault")


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading dot and a trailing dot make no suffix."""
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def suffix(name: Column) -> Column:
    """The lower-cased suffix without its dot, or 'no extension'."""
    found = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return F.when(found == "", "no extension").otherwise(found)


def name_grams(names: DataFrame, side: str, lengths: tuple[int, ...] = (3, 5, 7, 10), n: int = 20) -> DataFrame:
    """The n most frequent lower-cased prefixes (side 'left') or suffixes ('right') of stems, of each length that fits."""
    s = F.lower(stem(F.col("file")))
    cut = [F.when(F.length(s) >= k, F.left(s, F.lit(k)) if side == "left" else F.right(s, F.lit(k))) for k in lengths]
    grams = names.select(F.explode(F.array_compact(F.array(*cut))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "gram").limit(n)


def name_words(names: DataFrame, n: int = 30) -> DataFrame:
    """The n most frequent words of three ASCII letters and more in stems, counted by occurrence."""
    words = names.select(F.explode(F.regexp_extract_all(stem(F.col("file")), F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "word").limit(n)


def name_flags(names: DataFrame) -> DataFrame:
    """names with a boolean column for each pattern."""
    f, s = F.col("file"), stem(F.col("file"))
    date = f.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{8}")
    time = f.rlike(r"[0-9]{1,2}\.[0-9]{2}\.[0-9]{2}|[0-9]{6}|[0-9]{2}:[0-9]{2}:[0-9]{2}")
    return names.withColumns({
        "date_time": date & time,
        "date_only": date & ~time,
        "uuid": F.lower(f).rlike("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
        "hash": F.lower(s).rlike("^[0-9a-f]{16,}$"),
        "sequential": f.rlike("[0-9]"),
        "screenshot_word": F.lower(f).rlike("|".join(vocab.SCREENSHOT_WORDS)),
        "short_name": F.length(s) < 5,
        "long_name": F.length(s) > 30,
        "no_extension": suffix(f) == "no extension",
    })


FLAGS = "date_time date_only uuid hash sequential screenshot_word short_name long_name no_extension".split()


def name_flag_counts(names: DataFrame) -> DataFrame:
    """One row for each pattern: how many names have it, and in percent. One pass."""
    counts = name_flags(names).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in FLAGS])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("files")) for c in FLAGS]))
    return counts.select("n", each.alias("e")).select("e.flag", "e.files", F.coalesce(F.try_divide(F.lit(100.0) * F.col("e.files"), F.col("n")), F.lit(0.0)).alias("pct"))


def screenshots(names: DataFrame) -> DataFrame:
    """Likely screenshots with their sub-category: a bag union of two rules, so a name can stand twice."""
    flags = name_flags(names).where("screenshot_word")
    both = flags.where("date_time").unionAll(flags.where("sequential"))
    f = F.col("file")
    kind = (
        F.when(f.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*[0-9]+\.[0-9]+\.[0-9]+"), "date_time_formatted")
        .when(F.lower(f).rlike("screenshot.*[0-9]"), "screenshot_numbered")
        .when(F.lower(f).rlike("img.*[0-9]"), "img_numbered")
        .otherwise("other")
    )
    return both.select("doc_id", "file", kind.alias("category"))


def discovered_patterns(names: DataFrame, examples: int = 5) -> DataFrame:
    """Patterns that occur, with their first examples by name."""
    flags = name_flags(names)
    rules = {
        "screenshot_date_time": F.col("date_time") & F.col("screenshot_word"),
        "screenshot_sequential": F.col("sequential") & F.col("screenshot_word"),
        "img_sequential": F.lower("file").rlike("^img[_-][0-9]"),
    }
    hits = flags.select("file", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("pattern"))
    first = W.partitionBy("pattern").orderBy("file", "n")
    numbered = hits.groupBy("pattern", "file").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= examples)
    return numbered.select("pattern", "rank", "file")


def human_size(size: Column) -> Column:
    """B to TB with two decimals, half to even."""
    out = F.format_string("%.2f TB", F.bround(size / F.lit(1024.0**4), 2))
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        out = F.when(size < F.lit(1024.0 ** (power + 1)), F.format_string(f"%.2f {unit}", F.bround(size / F.lit(1024.0**power), 2))).otherwise(out)
    return out


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """Per conversation with a user's or an assistant's message: numbers, characters and means of both roles."""
    ua = messages.where(F.col("role").isin("user", "assistant"))
    by = lambda r: F.when(F.col("role") == r, F.length("text").cast("long"))
    out = ua.groupBy("conv_id").agg(*[c for r in ("user", "assistant") for c in (F.count_if(F.col("role") == r).alias(f"{r}_messages"), F.coalesce(F.sum(by(r)), F.lit(0)).alias(f"{r}_chars"))])
    mean = lambda r: F.coalesce(F.try_divide(F.col(f"{r}_chars").cast("double"), F.col(f"{r}_messages")), F.lit(0.0))
    return out.withColumns({"total_chars": F.col("user_chars") + F.col("assistant_chars"), "avg_user": mean("user"), "avg_assistant": mean("assistant")})


def conversation_summary(rollup: DataFrame) -> DataFrame:
    """One row: means, medians and extremes of the corpus, single-turn and multi-turn conversations; mean and median of
    the conversations' mean message lengths, where a role has messages."""
    of = ("user_messages", "assistant_messages", "user_chars", "assistant_chars", "total_chars")
    rollup = rollup.withColumns({f"{r}_length": F.when(F.col(f"{r}_messages") > 0, F.col(f"avg_{r}")) for r in ("user", "assistant")})
    cols = [f(c).alias(f"{n}_{c}") for c in of for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))] + [F.avg(f"{r}_length").alias(f"avg_{r}_length") for r in ("user", "assistant")]
    one = rollup.agg(F.count("*").alias("conversations"), F.count_if(F.col("user_messages") <= 2).alias("single_turn"), F.count_if(F.col("user_messages") > 2).alias("multi_turn"), *cols)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in (*of, "user_length", "assistant_length")]))
    found = ranks.medians(rollup.select(each.alias("e")).select("e.*"), ["of"], "value", "median")
    row = found.agg(*[F.max(F.when(F.col("of") == c, F.col("median"))).alias(f"median_{c}") for c in (*of, "user_length", "assistant_length")])
    return one.crossJoin(F.broadcast(row))


def nearest_rank(values: DataFrame, column: str, percents: tuple[int, ...] = (50, 75, 80, 90, 95, 99)) -> DataFrame:
    """For each p the value at 0-based rank floor(n p / 100) of the sorted column, nulls first; see ranks."""
    n, nulls = values.agg(F.count("*"), F.count_if(F.col(column).isNull())).first()
    at = {p: n * p // 100 - nulls for p in percents}
    asked = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(r).cast("long").alias("rank")) for p, r in at.items() if r >= 0] or [F.struct(F.lit(0).alias("name"), F.lit(-1).cast("long").alias("rank"))])
    found = ranks.at_ranks(values, [], column, lambda _: asked).select(F.col("name").alias("percent"), F.col("value").cast(values.schema[column].dataType).alias("value"))
    low = [p for p, r in at.items() if r < 0 and n]
    return found.unionByName(values.sparkSession.createDataFrame([(p, None) for p in low], found.schema)) if low else found


LENGTH_BINS = [(0, 1000), (1000, 5000), (5000, 10000), (10000, 20000), (20000, 999999)]


def length_histogram(rollup: DataFrame) -> DataFrame:
    """Conversations by length bin; bins without any stay, longer ones than the last bin's end fall in none."""
    whole = rollup.agg(F.count("*").alias("total"), *[F.count_if((F.col("total_chars") >= lo) & (F.col("total_chars") < hi)).alias(f"b{lo}") for lo, hi in LENGTH_BINS])
    each = F.explode(F.array(*[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(f"b{lo}").alias("conversations")) for lo, hi in LENGTH_BINS]))
    return whole.select("total", each.alias("e")).select("e.*", F.coalesce(F.try_divide(F.lit(100.0) * F.col("e.conversations"), F.col("total")), F.lit(0.0)).alias("pct"))


#: Sampling strategies: limits of characters of a user's and an assistant's message, and of messages.
STRATEGIES = [("current", 2000, 500, 3), ("conservative", 1000, 300, 3), ("aggressive", 3000, 800, 5), ("full_single", 999999, 500, 5)]


def coverage(rollup: DataFrame, strategies: list[tuple[str, int, int, int]] = STRATEGIES) -> DataFrame:
    """How much of all characters each strategy would sample: messages up to a limit each; beyond two user messages only
    the first few count, at the mean length. One pass over the rollup for all strategies."""

    def captured(role: str, limit: int, most: int) -> Column:
        n, chars = F.col(f"{role}_messages"), F.col(f"{role}_chars").cast("double")
        return F.when(F.col("user_messages") <= 2, F.least(chars, n * F.lit(float(limit)))).otherwise(F.least(F.least(n, F.lit(most)) * F.least(F.col(f"avg_{role}"), F.lit(float(limit))), chars))

    sums = [F.sum(captured("user", u, m) + captured("assistant", a, m)).alias(name) for name, u, a, m in strategies]
    whole = rollup.agg(F.sum("total_chars").alias("total_chars"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(s[0]).alias("strategy"), F.col(s[0]).alias("captured")) for s in strategies]))
    return whole.select("total_chars", each.alias("e")).select("e.strategy", "total_chars", F.round("e.captured", 3).alias("captured_chars"), F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("e.captured"), F.col("total_chars")), F.lit(0.0)), 6).alias("coverage_pct"))


def prompt_samples(messages: DataFrame) -> DataFrame:
    """The text of each conversation that a model would see: up to two user messages, 10,000 characters of all messages;
    else 3,000 of the first five of each role. One aggregate a conversation; only the kept starts are collected."""
    ua = messages.where(F.col("role").isin("user", "assistant"))
    order = W.partitionBy("conv_id", "role").orderBy("turn")
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("conv_id"))
    ranked = ua.withColumn("users", users).withColumn("rank", F.row_number().over(order))
    kept = ranked.where((F.col("users") <= 2) | (F.col("rank") <= 5))
    part = F.struct("turn", F.when(F.col("users") <= 2, F.left("text", F.lit(10000))).otherwise(F.left("text", F.lit(3000))).alias("t"))
    side = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, part))), lambda x: x["t"]), "\n").alias(f"{r}_sample")
    out = kept.groupBy("conv_id").agg(F.max("users").alias("user_messages"), side("user"), side("assistant"))
    return out.withColumn("token_estimate", F.expr("(length(user_sample) + length(assistant_sample)) div 4").cast("long"))


def previews(messages: DataFrame, budget: int = 3000) -> DataFrame:
    """Lines of each conversation while the characters before the line, with its breaks, stay under the budget."""
    order = W.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = messages.withColumn("before", before)
    return lines.where(F.col("before") < budget).groupBy("conv_id").agg(F.count("*").alias("lines"), F.sum(F.length("text") + 1).alias("chars"))


def keyed_sample(rows: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """A uniform sample of n rows without replacement, the same each time: the smallest hashes of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def merged_document(notes: DataFrame, group: str, title: str, body: str, order: str) -> DataFrame:
    """The notes of each group in order as one text, a line of = between them."""
    rule = "\n" + "=" * 80 + "\n"
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(title), F.lit("\n"), F.col(body)).alias("t"))))
    return notes.groupBy(group).agg(F.count("*").alias("notes"), F.array_join(F.transform(parts, lambda x: x["t"]), rule).alias("merged"))


def sorted_scan(files: DataFrame, *keys: str, limit: int = 0) -> DataFrame:
    """files in order of keys (by code point), the first `limit` of them; 0 takes all."""
    ordered = files.orderBy(*keys)
    return ordered.limit(limit) if limit > 0 else ordered
