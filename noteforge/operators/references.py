"""Links from notes to attachments: resolved references, orphans, verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.functions import text
from noteforge.operators.stats import keyed_sample
from noteforge.session import ship_package, stored


def wiki_links(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(text.wiki_links(F.col("content"))).alias("link"))


def md_links(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(text.md_links(F.col("content"))).alias("l")).select("path", "l.alt", "l.url")


def references(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(path, rel_path), distinct: wiki links by base name, to every file of that name; links with attachments/ in them
    by path. Links are made distinct before they are joined."""
    wiki = wiki_links(notes).distinct()
    by_name = wiki.where(~F.lower("link").contains("attachments/")).join(attachments.select("rel_path", F.col("name").alias("link")), "link").select("path", "rel_path")
    urls = wiki.select("path", "link").unionByName(md_links(notes).select("path", F.col("url").alias("link")))
    by_path = urls.select("path", text.attachment_path(F.col("link")).alias("rel_path")).where("rel_path is not null")
    return by_name.unionByName(by_path.join(attachments.select("rel_path"), "rel_path", "left_semi").select("path", "rel_path")).distinct()


def orphans(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments that no note refers to, without copies that are not kept; `via_copy` tells that a note refers to a
    copy of the kept file."""
    from noteforge.operators.dedup import keep_one

    groups = keep_one(attachments, "rel_path")
    used = references(notes, attachments).select("rel_path").distinct()
    free = attachments.join(used, "rel_path", "left_anti").join(groups.where("not is_kept").select("rel_path"), "rel_path", "left_anti")
    via = groups.where("not is_kept").join(used, "rel_path", "left_semi").select(F.col("kept").alias("rel_path")).distinct().withColumn("via_copy", F.lit(True))
    return free.join(via, "rel_path", "left").select("rel_path", "name", "size", F.coalesce("via_copy", F.lit(False)).alias("via_copy"))


#: Characters of the patterns that one automaton holds, about.
SLICE_CHARACTERS = 4_000_000


def found_patterns(texts: DataFrame, text_col: str, patterns: DataFrame, slice_characters: int = SLICE_CHARACTERS) -> DataFrame:
    """pattern, of patterns (column pattern), of each that any text holds, once. Patterns are cut into slices of a bounded
    size; for each slice the tasks build one Aho-Corasick automaton and pass once over every text, so the work is texts
    times slices, not texts times patterns. What a task reports is each pattern once. Null and empty patterns go."""
    spark = texts.sparkSession
    wanted = stored(patterns.select("pattern").where("pattern <> ''").distinct(), "patterns")
    whole = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    slices = -(-whole // slice_characters)
    ship_package(spark)
    out = None
    for i in range(slices):
        part = [r[0] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == i).collect()]
        held = spark.sparkContext.broadcast(part)
        found = stored(texts.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(pattern_search(held), "pattern string").distinct(), "found")
        held.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else wanted


def pattern_search(held):
    """For mapInPandas: the patterns of a broadcast list that the rows' texts hold."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in held.value:
            automaton.add_word(p, p)
        if not len(automaton):
            return
        automaton.make_automaton()
        known: set[str] = set()
        for batch in batches:
            fresh = {p for text in batch["text"] for _, p in automaton.iter(text)} - known
            known |= fresh
            yield pd.DataFrame({"pattern": sorted(fresh)})

    return search


def verified_sample(notes: DataFrame, found: DataFrame, least: int = 100) -> DataFrame:
    """A check of orphans against whole contents: max(least, 5 %) of them, and whether any note holds a form of their
    name. Orphans are computed once; the sample's forms are searched together, see found_patterns()."""
    found = stored(found.select("rel_path", "name"), "orphans")
    n = max(least, found.count() // 20)
    sample = stored(keyed_sample(found, "rel_path", n).select("rel_path", "name"), "sample")
    name = F.col("name")
    forms = F.array(F.concat(F.lit("[["), name, F.lit("]]")), F.concat(F.lit("("), name, F.lit(")")), F.concat(F.lit("Attachments/"), name), F.col("rel_path"))  # ![[name]] holds [[name]]
    by_form = sample.select("rel_path", F.explode(forms).alias("pattern"))
    hits = by_form.join(found_patterns(notes, "content", by_form), "pattern").select("rel_path").distinct().withColumn("hit", F.lit(True))
    return sample.join(hits, "rel_path", "left").select("rel_path", F.coalesce("hit", F.lit(False)).alias("mentioned"))


def group_orphans(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments that in a name group one note alone refers to (see note_attachments), which is not the original."""
    from noteforge.operators.dedup import name_groups

    groups = name_groups(notes).select("path", "base", "is_original")
    links = note_attachments(notes, attachments).join(groups, "path").groupBy("base", "name").agg(F.count("*").alias("notes"), F.min("path").alias("path"), F.bool_or("is_original").alias("by_original"))
    return links.where("notes = 1 and not by_original").select("base", "name", "path")


def link_counts(notes: DataFrame) -> DataFrame:
    """Distinct wiki targets and addresses of each note that has any."""
    both = wiki_links(notes).select("path", F.lit("wiki").alias("kind"), "link").unionByName(md_links(notes).select("path", F.lit("md").alias("kind"), F.col("url").alias("link"))).distinct()
    return both.groupBy("path").agg(F.count_if(F.col("kind") == "wiki").alias("wiki_links"), F.count_if(F.col("kind") == "md").alias("md_links"))


def audio_embeds(notes: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, rel_path) of audio that notes embed: ![[name]], with or without an alias, by file name (the first path of
    that name), or an image address with attachments/ in it, by path. The link itself must end with an extension."""
    ends = lambda c: reduce(lambda a, b: a | b, [F.endswith(F.lower(c), F.lit(f".{e}")) for e in extensions])
    audio = files.where(ends(F.col("name")))
    first = audio.groupBy("name").agg(F.min("rel_path").alias("rel_path"))
    embeds = notes.select("path", F.explode(text.all_groups(F.col("content"), r"!\[\[([^\]]+)\]\]")).alias("e")).select("path", F.split_part("e", F.lit("|"), F.lit(1)).alias("name"))
    images = notes.select("path", F.explode(text.all_groups(F.col("content"), r"!\[[^\]]*\]\(([^)]+)\)")).alias("url")).where(ends(F.col("url")))
    urls = images.select("path", text.attachment_path(F.col("url")).alias("rel_path"))
    there = urls.join(files.select("rel_path"), "rel_path", "left_semi").select("path", "rel_path")
    return embeds.where(ends(F.col("name"))).join(first, "name").select("path", "rel_path").unionByName(there).distinct()


def note_attachments(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(path, name), distinct, as the search for duplicate notes reads links: the whole text between [[ and ]] is a path
    below the attachments that must exist; an image address counts by what follows its last Attachments/, there or not."""
    wiki = notes.select("path", F.explode(text.all_groups(F.col("content"), text.WIKI)).alias("rel_path")).distinct()
    there = wiki.join(attachments.select("rel_path", "name"), "rel_path").select("path", "name")
    images = notes.select("path", F.explode(text.all_groups(F.col("content"), r"!\[[^\]]*\]\(([^)]+)\)")).alias("url")).where(F.contains("url", F.lit("Attachments/")))
    return there.unionByName(images.select("path", F.element_at(F.split("url", "Attachments/"), -1).alias("name"))).distinct()


#: Renamed names of more different lengths than this are joined by every ending of an address.
MOST_LENGTHS = 64


def renamed(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """Notes with embeds of and links to renamed files (old, new) rewritten. Only notes with such a target are touched:
    embeds by equality, and the endings of the last part of an address by equality too, those of the lengths that old
    names have. A note's renames are applied one after the other."""
    embeds = notes.select("path", F.explode(text.all_groups(F.col("content"), r"!\[\[([^\]]+)\]\]")).alias("e")).select("path", F.split_part("e", F.lit("|"), F.lit(1)).alias("old"))
    parts = notes.select("path", F.explode(text.all_groups(F.col("content"), r"\]\(([^)]*)\)")).alias("url")).select("path", text.base_name(F.col("url")).alias("b")).where("b <> ''").distinct()
    lengths = [r[0] for r in renames.select(F.length("old")).where("old <> ''").distinct().limit(MOST_LENGTHS + 1).collect()]
    ends = F.transform(F.filter(F.lit(sorted(lengths) or [0]), lambda n: (n > 0) & (n <= F.length("b"))), lambda n: F.right("b", n)) if len(lengths) <= MOST_LENGTHS else F.expr("transform(sequence(1, length(b)), i -> substring(b, i))")
    ends = parts.select("path", F.explode(ends).alias("old"))
    todo = embeds.unionByName(ends).distinct().join(renames, "old").groupBy("path").agg(F.sort_array(F.collect_set(F.struct("old", "new"))).alias("todo"))
    new = F.aggregate("todo", F.col("content"), lambda t, r: text.renamed_links(t, r["old"], r["new"]))
    done = notes.join(todo, "path").select("path", F.size("todo").alias("renames"), "content", new.alias("new_content"))
    return done.where("content <> new_content").drop("content")
