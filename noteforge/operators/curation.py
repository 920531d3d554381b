"""Notes as text: tags, languages, hashtags, archive notes, sections, agents, paths, transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge import vocab
from noteforge.functions import arrow, text
from noteforge.operators import language
from noteforge.session import ship_package, stored


def tag_rows(notes: DataFrame) -> DataFrame:
    """(path, tag, mapped) of inline tags, once for each occurrence; mapped is null for tags that go."""
    found = notes.select("path", text.inline_tags(F.col("content")).alias("line")).where("line is not null")
    return found.select("path", F.explode(text.map_tags(text.tag_list(F.col("line")))).alias("t")).select("path", "t.*")


def normalised_notes(notes: DataFrame) -> DataFrame:
    """Notes with inline tags: kept (distinct) and removed tags, and the content with a sorted YAML list instead."""
    content = F.col("content")
    found = notes.withColumn("line", text.inline_tags(content)).where("line is not null")
    found = found.withColumn("mapped", text.map_tags(text.tag_list(F.col("line"))))
    kept = F.array_distinct(F.transform(F.filter("mapped", lambda t: t["mapped"].isNotNull()), lambda t: t["mapped"]))
    removed = F.transform(F.filter("mapped", lambda t: t["mapped"].isNull()), lambda t: t["tag"])
    found = found.withColumns({"kept": kept, "removed": removed})
    return found.select("path", F.size("kept").alias("n_kept"), F.size("removed").alias("n_removed"), text.yaml_tags(F.col("kept")).alias("yaml"), F.replace(content, F.col("line"), text.yaml_tags(F.col("kept"))).alias("new_content"))


def tag_frequency(notes: DataFrame, n: int = 100) -> DataFrame:
    """The most frequent kept tags (once a note) and removed ones (each occurrence), n of each."""
    rows = tag_rows(notes)
    kept = rows.where("mapped is not null").select("path", F.col("mapped").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag").limit(n)
    gone = rows.where("mapped is null").groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag").limit(n)
    return kept.withColumn("status", F.lit("kept")).unionByName(gone.withColumn("status", F.lit("removed")))


def tag_totals(notes: DataFrame) -> DataFrame:
    done = normalised_notes(notes)
    return done.agg(F.count("*").alias("notes"), F.coalesce(F.sum("n_kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("n_removed"), F.lit(0)).alias("removed"))


def language_rows(notes: DataFrame, least: float = 0.5, add_only: bool = False, detector=None) -> DataFrame:
    """path, lang, confidence, tag, status, new_content of each note. detector: a function that adds best and prob, a
    language and its probability, to rows with path and plain, as a language.LanguageModel does; without, only the words
    decide. Statuses, the first that holds: no_frontmatter, short, uncertain, correct, add_only_kept, changed, added,
    unfixable."""
    rows = notes.select("path", "content", text.frontmatter_block(F.col("content")).alias("front"), text.plain_text(F.col("content")).alias("plain"))
    rows = detector(rows) if detector else rows.withColumns({"best": F.lit(None).cast("string"), "prob": F.lit(0.0)})
    rows = language.decided(rows, "plain").withColumn("tag", text.language_tag(F.col("front")))
    new = text.with_language(F.col("content"), F.col("lang"))
    status = (
        F.when(F.col("front") == "", "no_frontmatter")
        .when(F.length("plain") < 50, "short")
        .when(F.col("lang").isNull() | (F.col("confidence") < least), "uncertain")
        .when(F.col("tag") == F.col("lang"), "correct")
        .when(F.col("tag").isNotNull() & F.lit(add_only), "add_only_kept")
        .when(F.col("tag").isNotNull(), "changed")
        .when(new != F.col("content"), "added")
        .otherwise("unfixable")
    )
    rows = rows.withColumn("status", status)
    return rows.select("path", "lang", F.round("confidence", 9).alias("confidence"), "tag", "status", F.when(F.col("status").isin("changed", "added"), new).alias("new_content"))


def language_funnel(notes: DataFrame, **options) -> DataFrame:
    """One row with the counters of a run over notes: what was scanned, skipped, detected, right and fixed. What is
    detected and isn't English counts as Spanish."""
    rows = language_rows(notes, **options)
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    seen = ("correct", "add_only_kept", "changed", "added", "unfixable")
    english = F.col("lang") == "en"
    found = lambda which: F.count_if(F.col("status").isin(*seen) & which)
    return rows.agg(
        F.count("*").alias("notes_scanned"), of("no_frontmatter").alias("skipped_no_frontmatter"), of("short").alias("skipped_short"), of("uncertain").alias("skipped_uncertain"), found(english).alias("detected_en"), found(~english).alias("detected_es"),
        of("correct", "add_only_kept").alias("correct"), of("added").alias("added"), of("changed").alias("changed"), of("added", "changed").alias("fixed"), F.count_if(F.col("status").isNull()).alias("errors"),
    )


def hashtag_rows(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(arrow.hashtags("content")).alias("h")).select("path", "h.*")


def hashtag_frequency(notes: DataFrame, n: int = 30) -> DataFrame:
    by = hashtag_rows(notes).groupBy("tag").agg(F.count("*").alias("uses"), F.count_distinct("path").alias("notes"))
    return by.orderBy(F.desc("uses"), "tag").limit(n)


def escaped_notes(notes: DataFrame) -> DataFrame:
    done = notes.select("path", "content", arrow.escape_hashtags("content").alias("new_content"))
    return done.where("content <> new_content").select("path", "new_content")


def archive_rows(notes: DataFrame, date: str) -> DataFrame:
    """Notes without frontmatter: language, kind, topics, usefulness, and the content with both added."""
    rows = notes.where(~text.has_frontmatter(F.col("content")))
    name, content = F.col("name"), F.col("content")
    return rows.select(
        "path", text.archive_language(content).alias("lang"), text.archive_kind(name).alias("kind"), F.array_join(text.archive_topics(name, content), ",").alias("topics"),
        F.round(text.usefulness(name, content), 6).alias("usefulness"), F.concat(text.archive_frontmatter(name, content, date), text.with_reflection(content)).alias("new_content"),
    )


def archive_topics_top(notes: DataFrame, n: int = 10) -> DataFrame:
    topics = notes.where(~text.has_frontmatter(F.col("content"))).select(F.explode(text.archive_topics(F.col("name"), F.col("content"))).alias("topic"))
    return topics.groupBy("topic").agg(F.count("*").alias("notes")).orderBy(F.desc("notes"), "topic").limit(n)


def archive_totals(notes: DataFrame) -> DataFrame:
    """Per language: notes without frontmatter and their mean usefulness."""
    rows = notes.where(~text.has_frontmatter(F.col("content"))).select(text.archive_language(F.col("content")).alias("lang"), text.usefulness(F.col("name"), F.col("content")).alias("u"))
    return rows.groupBy("lang").agg(F.count("*").alias("notes"), F.round(F.avg("u"), 6).alias("avg_usefulness"))


MODELS = ["sonnet", "opus", "haiku"]


def agent_rows(files: DataFrame, skills: DataFrame) -> DataFrame:
    """path, name, valid, errors, warnings of agent files. skills: the names of the skill files that exist. A description
    is broken if it is bare and one of the five lines below it in the frontmatter is neither indented nor a key."""
    rows = files.select("path", "content", arrow.mini_yaml("content").alias("fm"))
    body = text.body_of(F.col("content"))
    desc, model = F.col("fm.description"), F.col("fm.model")
    none = F.size("fm") <= 0
    front = text.front_rows(F.col("content"))
    value = lambda x: text.strip(F.substring(x, F.lit(13), F.length(x)))
    bare = lambda x: x.startswith("description:") & (value(x) != "") & ~value(x).rlike("^[\"']") & ~value(x).isin("|", ">")
    loose = lambda x: (text.strip(x) != "") & ~x.startswith("  ") & ~x.contains(":")
    numbered = F.transform(front, lambda x, i: F.struct(x.alias("x"), F.slice(front, i + 2, F.lit(5)).alias("next")))
    broken = F.col("content").startswith("---") & F.exists(numbered, lambda r: bare(r["x"]) & F.exists(r["next"], loose))
    rules = [
        F.when(broken, "Description spans lines without quotes"),
        F.when(none, "No frontmatter"),
        F.when(~none & F.col("fm.name").isNull(), "Missing field: name"),
        F.when(~none & desc.isNull(), "Missing field: description"),
        F.when(~none & desc.contains("\n") & ~desc.contains("\\n"), "Description has line breaks"),
        F.when(~none & model.isNotNull() & ~model.isin(MODELS), F.concat(F.lit("Invalid model: "), model)),
    ]
    hints = [F.when(~none & desc.isNotNull() & ~desc.contains("<example>"), "No example"), F.when(~none & model.isNull(), "No model"), F.when(~none & (text.strip(body) == ""), "Empty body")]
    rows = rows.withColumns({"errors": F.array_compact(F.array(*rules)), "hints": F.array_compact(F.array(*hints))})
    # Rows without frontmatter have no skills to explode; a filter on fm would parse each file once more, by a second worker.
    wanted = rows.select("path", F.explode(F.transform(F.split("fm.skills", ","), text.strip)).alias("skill"))
    missing = wanted.join(skills, "skill", "left_anti").groupBy("path").agg(F.sort_array(F.collect_set(F.concat(F.lit("Missing skill: "), F.col("skill")))).alias("missing"))
    out = rows.join(missing, "path", "left")
    warnings = F.concat("hints", F.coalesce("missing", F.array().cast("array<string>")))
    return out.select("path", F.col("fm.name").alias("name"), (F.size("errors") == 0).alias("valid"), "errors", warnings.alias("warnings"))


def agent_files(files: DataFrame) -> DataFrame:
    """files (rel_path) that are agents or skills, with kind: Markdown right in .claude/agents or .claude/skills, and the
    SKILL.md of each folder of .claude/skills."""
    p = F.col("rel_path")
    kind = F.when(p.rlike(r"^\.claude/agents/[^/]*\.md$"), "agent").when(p.rlike(r"^\.claude/skills/([^/]*\.md|[^/]+/SKILL\.md)$"), "skill")
    return files.withColumn("kind", kind).where("kind is not null")


def validation_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.count_if("valid").alias("valid"), F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"), F.max(F.when(F.col("valid"), 0).otherwise(1)).alias("exit_code"))


def path_rows(notes: DataFrame, base: str, wiki: str = "all", limit: int = 0) -> DataFrame:
    """(path, ordinal, found, resolved) of paths in notes, the first of equal resolved ones; with a limit, the first so
    many of each note. wiki: all kinds of paths;
    only: those of wiki links; prefer: those of wiki links in notes that have any. Distinct paths are resolved once."""
    links = text.wiki_links(F.col("content"))
    every = text.extracted_paths(F.col("content"))
    chosen = {"all": every, "only": links, "prefer": F.when(F.size(links) > 0, links).otherwise(every)}[wiki]
    found = notes.select("path", F.posexplode(chosen).alias("ordinal", "found"))
    found = found.withColumn("resolved", text.resolved_path(F.col("found"), base))
    out = found.groupBy("path", "resolved").agg(F.min(F.struct("ordinal", "found")).alias("f")).select("path", "f.*", "resolved")
    return out.withColumn("_rank", F.row_number().over(W.partitionBy("path").orderBy("ordinal"))).where(F.col("_rank") <= limit).drop("_rank") if limit > 0 else out


#: Literal characters in a row that a pattern's block is named by, at most.
BLOCK = 32


def glob_tokens(pattern: str) -> list[tuple[str | None, str]]:
    """The parts of a file-name pattern (*, ?, [..], [!..]): the character that a part stands for, null for signs, and its
    regular expression for Java. A bracket that is not closed stands for itself; ranges whose ends are the wrong way round
    match nothing. All parts but * take one character of a name."""
    out, at = [], 0
    quote = lambda c: c if c.isalnum() or ord(c) > 127 else "\\" + c
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if c == "[" else -1
        if close > 0:
            inner, no = pattern[at + 1 : close], pattern[at + 1] == "!"
            inner, kept, i = inner[no:], [], 0
            while i < len(inner):
                if inner[i + 1 : i + 2] == "-" and i + 2 < len(inner):
                    kept += [f"{quote(inner[i])}-{quote(inner[i + 2])}"] if inner[i] <= inner[i + 2] else []
                    i += 3
                else:
                    kept.append(quote(inner[i]))
                    i += 1
            out.append((None, f"[{'^' * no}{''.join(kept)}]" if kept else "." if no else "(?!)"))
            at = close + 1
        else:
            out.append((None, {"*": ".*", "?": "."}[c]) if c in "*?" else (c, quote(c)))
            at += 1
    return out


def glob_regex(pattern: str) -> str:
    """The regular expression of a file-name pattern, for whole names."""
    return "(?s)^" + "".join(r for _, r in glob_tokens(pattern)) + r"\z"


def glob_block(pattern: str) -> tuple[str, int, str, int]:
    """(side, at, block, whole): the longest literal characters in a row that each match has, and where: `at` characters
    behind the start, in front of the end, or (side in) anywhere; a known place is worth two characters. whole: the
    length of all matches of a pattern without a *, else -1."""
    tokens = glob_tokens(pattern)
    stars = [i for i, (_, r) in enumerate(tokens) if r == ".*"]
    runs, i = [("any", 0, "")], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j][0] is not None:
            j += 1
        run = "".join(c for c, _ in tokens[i:j])
        if run and (not stars or j <= stars[0]):
            runs.append(("start", i, run[:BLOCK]))
        elif run and i > stars[-1]:
            runs.append(("end", len(tokens) - j, run[-BLOCK:]))
        elif run:
            runs.append(("in", 0, run[:BLOCK]))
        i = j + 1
    return *max(runs, key=lambda r: len(r[2]) + 2 * (r[0] in ("start", "end"))), -1 if stars else len(tokens)


def glob_matches(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, name) of every pattern (column pattern) and name (column name) that match, distinct. A pattern is only
    compared with the names of its glob_block(): those with the same characters at the same place, and of its length if
    it has one. Patterns without a literal character are compared with all names (of their length); nothing else is."""
    ship_package(patterns.sparkSession)

    @F.pandas_udf("regex string, side string, at int, block string, whole int")
    def blocks(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(glob_regex(x), *glob_block(x)) for x in p], columns=["regex", "side", "at", "block", "whole"])

    p = patterns.select("pattern").where("pattern is not null").distinct().where(F.col("pattern").rlike(r"[*?\[\]]"))
    p = stored(p.select("pattern", blocks("pattern").alias("b")).select("pattern", "b.*"), "globs")
    kinds = p.select("side", "at", F.length("block").alias("n"), (F.col("whole") >= 0).alias("sized")).distinct()  # of places, not of patterns
    names = names.select("name").where("name is not null").distinct().withColumn("size", F.length("name"))
    at, n, size = F.col("at"), F.col("n"), F.col("size")
    cut = lambda start: F.substring("name", start, n)
    anywhere = F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), cut))
    block = F.when(F.col("side") == "in", anywhere).otherwise(F.array(cut(F.when(F.col("side") == "end", size - at - n + 1).otherwise(at + 1))))
    dealt = names.crossJoin(F.broadcast(kinds)).where(size >= at + n).select("name", "side", "at", F.explode(block).alias("block"), F.when(F.col("sized"), size).otherwise(-1).alias("whole"))
    return p.join(dealt, ["side", "at", "block", "whole"]).where(F.expr("name rlike regex")).select("pattern", "name").distinct()


def matched_paths(found: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that exist as they are, or every file whose name their base name matches as a pattern, or themselves.
    files: abs_path."""
    known = files.select(F.col("abs_path").alias("resolved"), F.lit(True).alias("there")).distinct()
    rows = stored(found.select("path", "resolved").distinct().join(known, "resolved", "left").withColumn("base", text.base_name(F.col("resolved"))), "found-paths")  # found may be read from texts: once
    there, gone = rows.where("there").select("path", "resolved"), rows.where("there is null").drop("there")
    named = files.select(text.base_name(F.col("abs_path")).alias("name"), "abs_path")
    globs = glob_matches(gone.select(F.col("base").alias("pattern")), named).select(F.col("pattern").alias("base"), "name")
    plain = gone.where(~F.col("base").rlike(r"[*?\[\]]")).select("base", F.col("base").alias("name")).distinct()
    hits = plain.unionByName(globs).join(named, "name").select("base", "abs_path")
    out = gone.join(hits, "base", "left").select("path", F.coalesce("abs_path", "resolved").alias("resolved"))
    return there.unionByName(out).distinct()


def transcripts(messages: DataFrame) -> DataFrame:
    """Conversations rendered as notes: conv_id, content."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("### User, on "), F.col("turn").cast("string"), F.lit(";\n> "), "text")).otherwise(F.concat(F.lit("#### ChatGPT, on "), F.col("turn").cast("string"), F.lit(";\n>> "), "text"))
    ua = messages.where(F.col("role").isin("user", "assistant"))
    parts = F.sort_array(F.collect_list(F.struct("turn", line.alias("l"))))
    return ua.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["l"]), "\n"), F.lit("\n")).alias("content"))


def parsed_messages(notes: DataFrame) -> DataFrame:
    return notes.select("conv_id", F.explode(text.transcript_messages(F.col("content"))).alias("m")).select("conv_id", "m.*")


#: The parts of a diagram's prompt; fixed values, between them the chapter's own.
PROMPT = (
    "Create a professional concept map infographic summarizing:\n\nCHAPTER: ", "\nFROM: ", "\n\nOVERVIEW:\n", "\n\nKEY CONCEPTS TO VISUALIZE:\n", "\n\nMAIN ARGUMENTS:\n",
    "\n\nCreate a concept map showing relationships between these ideas. Use arrows and connections to show how concepts relate. Place the chapter title prominently at top.\n\n",
)


def chapter_prompts(notes: DataFrame, style: str = "") -> DataFrame:
    """Chapters without a diagram that have an overview or arguments: title, book, points, headers and the prompt. The
    overview is cut at 400 characters, arguments and concepts at 600 before their points and headers are read; six
    headers are shown, or points where there are none, and four points. style is the caller's text on looks."""
    c = F.col("content")
    front = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda k, other: F.coalesce(F.nullif(text.strip(F.regexp_extract(front, rf'{k}:\s*"?([^"\n]+)"?', 1)), F.lit("")), F.lit(other))
    rows = notes.where(~text.has_diagram(c)).select("path", field("title", "Chapter Summary").alias("title"), field("book", "Book").alias("book"), *[text.section(c, h).alias(n) for n, h in (("overview", "Chapter Overview"), ("arguments", "Key Arguments"), ("concepts", "Core Concepts"))])
    rows = rows.where("overview <> '' or arguments <> ''")
    lines = F.filter(F.split(F.left("arguments", F.lit(600)), "\n"), lambda x: text.strip(x).startswith("- **"))
    points = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"\*\*([^*]+)\*\*", 1)), lambda x: x != "")
    heads = text.all_groups(F.left("concepts", F.lit(600)), r"(?d)###\s+(.+)")
    rows = rows.withColumns({"points": points, "headers": heads})
    bullets = lambda xs, n: F.array_join(F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("- "), x)), "\n")
    shown = F.when(F.size("headers") > 0, bullets(F.col("headers"), 6)).otherwise(bullets(F.col("points"), 6))
    own = [F.col("title"), F.col("book"), F.left("overview", F.lit(400)), shown, bullets(F.col("points"), 4), F.lit(f"{style}\n")]
    prompt = F.concat(*[x for fixed, part in zip(PROMPT, own, strict=True) for x in (F.lit(fixed), part)])
    return rows.select("path", "title", "book", F.size("points").alias("points"), F.size("headers").alias("headers"), prompt.alias("prompt"))


def chapter_totals(notes: DataFrame) -> DataFrame:
    """One row: chapters, those with a diagram, those that a prompt can be made for, those without content."""
    c = F.col("content")
    has, full = text.has_diagram(c), (text.section(c, "Chapter Overview") != "") | (text.section(c, "Key Arguments") != "")
    return notes.agg(F.count("*").alias("chapters"), F.count_if(has).alias("with_diagram"), F.count_if(~has & full).alias("to_make"), F.count_if(~has & ~full).alias("no_content"))


def analysis_block(date: str, model: str) -> Column:
    """The YAML of an analysis, from columns score, action, topics, has_framework, framework_description, key_questions
    and reasoning. No description is `null`; questions are quoted, reasoning is a block of indented lines; both are left
    out where there are none."""
    join = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    asked = F.transform("key_questions", lambda q: F.concat(F.lit('\n    - "'), F.replace(q, F.lit('"'), F.lit('\\"')), F.lit('"')))
    questions = F.when(F.size("key_questions") > 0, F.concat(F.lit("\n  key_questions:"), F.array_join(asked, ""))).otherwise("")
    reasons = F.when(F.col("reasoning") != "", F.concat(F.lit("\n  reasoning: |\n    "), F.replace("reasoning", F.lit("\n"), F.lit("\n    ")))).otherwise("")
    described = F.coalesce(F.nullif("framework_description", F.lit("")), F.lit("null"))
    return F.concat(
        F.lit("analysis:\n  quality_score: "), F.col("score").cast("string"), F.lit("\n  action: "), "action", F.lit("\n  topics: ["), join("topics", ", "), F.lit("]\n  has_framework: "), F.col("has_framework").cast("string"),
        F.lit("\n  framework_description: "), described, questions, reasons, F.lit(f"\n  analyzed_date: {date}\n  analyzed_model: {model}"),
    )


def analysis_frontmatter(notes: DataFrame, report: DataFrame, date: str, model: str) -> DataFrame:
    """Notes with their analysis block replaced by that of the report's row of the same path."""
    front = text.frontmatter_lines(F.col("content"))
    state = F.aggregate(
        front,
        F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct(
            ((text.strip(x) == "analysis:") | (s["skip"] & ((x == "") | x.rlike(r"^\s")))).alias("skip"),
            F.when((text.strip(x) == "analysis:") | (s["skip"] & ((x == "") | x.rlike(r"^\s"))), s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
        ),
    )
    rest = F.substring(F.col("content"), F.locate("\n---\n", F.col("content"), 4) + 5, F.length("content"))
    rows = notes.join(report, "path").where(front.isNotNull())
    return rows.select("path", F.concat(F.lit("---\n"), text.strip(F.array_join(state["kept"], "\n")), F.lit("\n"), analysis_block(date, model), F.lit("\n---\n"), rest).alias("new_content"))


def with_transcript(notes: DataFrame, texts: DataFrame) -> DataFrame:
    """Notes without a transcript, with that of texts (path, file, text) behind a rule at their end. A null text is a
    transcription that failed: its note stays as it is."""
    rows = notes.join(texts.where("text is not null"), "path").where(~text.has_transcript(F.col("content")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    added = F.concat("content", F.lit("\n\n---\n\n## Audio Transcript\n\n*Transcribed from: "), "file", F.lit("*\n\n"), "text", F.lit("\n\n"))
    return rows.select("path", words.alias("words"), added.alias("new_content"))


def keyword_tags(notes: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """(path, topic) for each topic with a keyword in the note, in any case."""
    low = F.lower("content")
    found = F.array_compact(F.array(*[F.when(text.any_of(low, words), topic) for topic, words in topics.items()]))
    return notes.select("path", F.explode(found).alias("topic"))


def approved(tag: Column) -> Column:
    return tag.isin(vocab.APPROVED_TAGS)
