"""Every query over the test tables, and its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge import vocab
from noteforge.functions import arrow, text
from noteforge.operators import curation, dedup, language, media, providers, references, reports, stats
from noteforge.plans import plan
from noteforge.sources.tables import ATTACHMENTS_SQL, BACKUP_SQL, NAMES_SQL, NOTES_SQL, PATHS_SQL, REPORT_SQL, attachments, backup, names, notes, paths, report, table
from noteforge.session import scratch
from noteforge.streaming import increments
from noteforge.streaming import report_upsert as upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "attachment_cleanup_plan"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- sizes -------------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"), F.col("n_chars").alias("size"))


BY_TYPE = """SELECT lang AS type, count(*) AS files, cast(sum(n_chars) AS bigint) AS total_size, avg(n_chars) AS avg_size, min(n_chars) AS min_size,
  max(n_chars) AS max_size, cast(median(n_chars) AS double) AS median_size, 100.0::double * sum(n_chars) / sum(sum(n_chars)) OVER () AS share FROM {} GROUP BY lang"""


@query("SELECT count(*) AS files, cast(sum(n_chars) AS bigint) AS total_size, avg(n_chars) AS avg_size FROM documents")
def stats_overall(spark, sf):
    return stats.stats_overall(files(spark, sf))


@query(BY_TYPE.format("documents"))
def stats_by_type(spark, sf):
    return stats.stats_by_type(files(spark, sf))


@query("SELECT lang AS type, count(*) AS files, cast(sum(n_chars) AS bigint) AS total_size, cast(grouping(lang) AS integer) AS is_total FROM documents GROUP BY ROLLUP (lang)")
def stats_with_total(spark, sf):
    return stats.stats_with_total(files(spark, sf))


@query("WITH top AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) SELECT s.*, 100.0::double * total_size / v.vault AS vault_share FROM (" + BY_TYPE.format("top") + ") s, (SELECT sum(n_chars) AS vault FROM documents) v")
def stats_top100_by_type(spark, sf):
    return stats.stats_of_largest(files(spark, sf), 100, "doc_id")


@query("SELECT doc_id, lang AS type, n_chars AS size FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def top10_largest(spark, sf):
    return stats.largest(files(spark, sf), 10, "doc_id")


# --- names -------------------------------------------------------------------------------------------------------------

STEM = "CASE WHEN regexp_matches(file, '^.+\\.[^.]+$') THEN regexp_replace(file, '\\.[^.]+$', '') ELSE file END"
GRAMS = "WITH " + NAMES_SQL + ", s AS (SELECT lower(" + STEM + ") AS s FROM names), l AS (SELECT unnest([3, 5, 7, 10]) AS l) SELECT {}(s, l) AS gram, count(*) AS files FROM s, l WHERE length(s) >= l GROUP BY 1 ORDER BY files DESC, gram LIMIT 20"


@query(GRAMS.format("left"))
def name_prefix_topk(spark, sf):
    return stats.name_grams(names(spark, sf), "left")


@query(GRAMS.format("right"))
def name_suffix_topk(spark, sf):
    return stats.name_grams(names(spark, sf), "right")


@query("WITH " + NAMES_SQL + ", w AS (SELECT lower(unnest(regexp_extract_all(" + STEM + ", '[A-Za-z]{3,}'))) AS word FROM names) SELECT word, count(*) AS uses FROM w GROUP BY word ORDER BY uses DESC, word LIMIT 30")
def name_word_topk(spark, sf):
    return stats.name_words(names(spark, sf))


FLAGS_SQL = (
    "WITH " + NAMES_SQL + ", f0 AS (SELECT *, " + STEM + " AS stem FROM names), f1 AS (SELECT *,"
    " regexp_matches(file, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{8}') AS d,"
    " regexp_matches(file, '[0-9]{1,2}\\.[0-9]{2}\\.[0-9]{2}|[0-9]{6}|[0-9]{2}:[0-9]{2}:[0-9]{2}') AS t FROM f0),"
    " flags AS (SELECT *, d AND t AS date_time, d AND NOT t AS date_only,"
    " regexp_matches(lower(file), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') AS uuid, regexp_matches(lower(stem), '^[0-9a-f]{16,}$') AS hash,"
    " regexp_matches(file, '[0-9]') AS sequential, regexp_matches(lower(file), '" + "|".join(vocab.SCREENSHOT_WORDS) + "') AS screenshot_word,"
    " length(stem) < 5 AS short_name, length(stem) > 30 AS long_name, NOT regexp_matches(file, '^.+\\.[^.]+$') AS no_extension FROM f1)"
)


@query(FLAGS_SQL + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS flag, count(*) FILTER ({c}) AS files, count(*) AS n FROM flags" for c in stats.FLAGS) + ") SELECT flag, files, 100.0::double * files / n AS pct FROM c")
def name_flag_counts(spark, sf):
    return stats.name_flag_counts(names(spark, sf))


@query(FLAGS_SQL + " SELECT doc_id, file, CASE WHEN regexp_matches(file, '[0-9]{4}-[0-9]{2}-[0-9]{2}.*[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'date_time_formatted' WHEN regexp_matches(lower(file), 'screenshot.*[0-9]') THEN 'screenshot_numbered' WHEN regexp_matches(lower(file), 'img.*[0-9]') THEN 'img_numbered' ELSE 'other' END AS category FROM (SELECT * FROM flags WHERE screenshot_word AND date_time UNION ALL SELECT * FROM flags WHERE screenshot_word AND sequential)")
def screenshot_bag_union(spark, sf):
    return stats.screenshots(names(spark, sf))


@query(FLAGS_SQL + ", h AS (SELECT 'screenshot_date_time' AS pattern, file FROM flags WHERE date_time AND screenshot_word UNION SELECT 'screenshot_sequential', file FROM flags WHERE sequential AND screenshot_word UNION SELECT 'img_sequential', file FROM flags WHERE regexp_matches(lower(file), '^img[_-][0-9]')) SELECT pattern, cast(row_number() OVER (PARTITION BY pattern ORDER BY file) AS integer) AS rank, file FROM h QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY file) <= 5")
def discovered_patterns(spark, sf):
    return stats.discovered_patterns(names(spark, sf))


@query("WITH " + NAMES_SQL + " SELECT doc_id, CASE WHEN regexp_matches(file, '^.+\\.[^.]+$') THEN lower(regexp_extract(file, '^.+\\.([^.]+)$', 1)) ELSE 'no extension' END AS type FROM names")
def file_types(spark, sf):
    return names(spark, sf).select("doc_id", stats.suffix(F.col("file")).alias("type"))


@query("WITH " + NAMES_SQL + " SELECT doc_id, size FROM names WHERE size > 2 * 1024")
def size_threshold_filter(spark, sf):
    return names(spark, sf).where("size > 2 * 1024").select("doc_id", "size")


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::double) WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0::double) WHEN n_chars < 1073741824 THEN printf('%.2f MB', n_chars / 1048576.0::double) WHEN n_chars < 1099511627776 THEN printf('%.2f GB', n_chars / 1073741824.0::double) ELSE printf('%.2f TB', n_chars / 1099511627776.0::double) END AS shown FROM documents")
def human_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", stats.human_size(F.col("n_chars").cast("double")).alias("shown"))


# --- paths -------------------------------------------------------------------------------------------------------------

HIDDEN = {
    "shared": "len(list_filter(string_split(rel_path, '/'), lambda p: starts_with(p, '.'))) > 0",
    "inverted": "len(list_filter(string_split(rel_path, '/'), lambda p: starts_with(p, '.'))) > 0 AND len(list_filter(string_split(rel_path, '/'), lambda p: p IN ('.trash', '.obsidian'))) = 0",
    "fallback": "len(list_filter(string_split(rel_path, '/'), lambda p: p IN ('.trash', '.obsidian'))) > 0",
    "none": "false",
}
for _policy, _sql in HIDDEN.items():
    query("WITH " + PATHS_SQL + f" SELECT doc_id, rel_path FROM paths WHERE NOT ({_sql})", f"hidden_policy_{_policy}")(lambda spark, sf, p=_policy: paths(spark, sf).where(~text.is_hidden(F.col("rel_path"), p)).select("doc_id", "rel_path"))


def attachment_files(spark, sf, extensions: list[str]) -> DataFrame:
    p = F.col("rel_path")
    inside = p.startswith("Attachments/") & ~F.array_contains(F.split(p, "/"), "backup")
    return paths(spark, sf).where(inside & F.lower(F.element_at(F.split(p, r"\."), -1)).isin(extensions)).select("doc_id", "rel_path", "size")


INSIDE = "SELECT doc_id, rel_path, size FROM paths WHERE starts_with(rel_path, 'Attachments/') AND NOT list_contains(string_split(rel_path, '/'), 'backup') AND lower(string_split(rel_path, '.')[-1]) IN "
for _kind, _ext in (("image", vocab.IMAGE_EXTENSIONS), ("audio", vocab.AUDIO_EXTENSIONS)):
    query("WITH " + PATHS_SQL + " " + INSIDE + f"({quoted(_ext)})", f"{_kind}_files")(lambda spark, sf, e=_ext: attachment_files(spark, sf, e))


@query("WITH " + PATHS_SQL + " SELECT DISTINCT rel_path FROM paths WHERE regexp_matches(rel_path, '\\.pdf$')")
def pdf_files(spark, sf):
    p = paths(spark, sf).where(F.col("rel_path").endswith(".pdf")).select("rel_path")
    return p.where(F.col("rel_path").startswith("Attachments/")).union(p.where(~F.col("rel_path").contains("/"))).union(p).distinct()


@query("WITH " + PATHS_SQL + f" SELECT doc_id, rel_path FROM paths WHERE len(list_intersect(string_split(rel_path, '/'), [{quoted(vocab.SYNC_SKIPPED)}])) = 0")
def snapshot_files(spark, sf):
    return paths(spark, sf).where(~F.arrays_overlap(F.split("rel_path", "/"), F.lit(vocab.SYNC_SKIPPED))).select("doc_id", "rel_path")


@query("WITH " + PATHS_SQL + " SELECT doc_id, rel_path, size FROM paths WHERE regexp_matches(rel_path, '\\.md$') AND len(list_intersect(string_split(rel_path, '/')[:-2], ['attachments', 'backup', 'logs', 'reports'])) = 0 AND size >= 100 AND lower(string_split(rel_path, '/')[-1]) NOT IN ('readme.md', 'index.md', '.obsidian')")
def sampler_candidates(spark, sf):
    parts = F.split("rel_path", "/")
    pruned = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(["attachments", "backup", "logs", "reports"]))
    rows = paths(spark, sf).where(F.col("rel_path").endswith(".md") & ~F.coalesce(pruned, F.lit(False)) & (F.col("size") >= 100))
    return rows.where(~F.lower(F.element_at(parts, -1)).isin("readme.md", "index.md", ".obsidian")).select("doc_id", "rel_path", "size")


@query("WITH " + PATHS_SQL + " SELECT doc_id, rel_path FROM paths WHERE regexp_matches(rel_path, '^INBOX/[^/]* - Chapters/[^/]*\\.md$') AND contains(lower(rel_path), 'dune')")
def chapter_files(spark, sf):
    return paths(spark, sf).where(F.col("rel_path").rlike(r"^INBOX/[^/]* - Chapters/[^/]*\.md$") & F.lower("rel_path").contains("dune")).select("doc_id", "rel_path")


# --- duplicates --------------------------------------------------------------------------------------------------------


def copies(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("source").alias("name"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"))


COPIES = "WITH copies AS (SELECT doc_id, source || '/' || lpad(cast(doc_id AS varchar), 12, '0') AS path, source AS name, n_chars AS size, md5(text) AS hash FROM documents), g AS (SELECT hash, count(*) AS copies, cast(sum(size) - max(size) AS bigint) AS removable_size FROM copies GROUP BY hash HAVING count(*) > 1) "


@query(COPIES + "SELECT * FROM g")
def exact_dup_groups(spark, sf):
    return dedup.hash_groups(copies(spark, sf))


@query(COPIES + "SELECT path, hash, g.copies, first_value(path) OVER w AS kept, row_number() OVER w = 1 AS is_kept FROM copies JOIN g USING (hash) WINDOW w AS (PARTITION BY hash ORDER BY size DESC, name, path)")
def exact_dup_keep_one(spark, sf):
    return dedup.keep_one(copies(spark, sf), "path")


@query(COPIES + "SELECT count(*) AS groups, cast(sum(copies - 1) AS bigint) AS duplicates, cast(sum(removable_size) AS bigint) AS removable_size FROM g")
def exact_dup_summary(spark, sf):
    return dedup.hash_summary(copies(spark, sf))


NAMED = "WITH " + NOTES_SQL + r""", n AS (SELECT doc_id, path, coalesce(nullif(regexp_extract(name, '^(.+) \(([0-9]+)\)\.md$', 1), ''), regexp_replace(name, '\.md$', '')) AS base,
  coalesce(try_cast(nullif(regexp_extract(name, '^(.+) \(([0-9]+)\)\.md$', 2), '') AS bigint), 0) AS number FROM notes) """


@query(NAMED + "SELECT doc_id, path, base, number, first_value(path) OVER w AS original, row_number() OVER w = 1 AS is_original FROM n WINDOW w AS (PARTITION BY base ORDER BY number, path) QUALIFY max(number) OVER (PARTITION BY base) > 0")
def name_dup_groups(spark, sf):
    return dedup.name_groups(notes(spark, sf)).select("doc_id", "path", "base", "number", "original", "is_original")


@query()
def near_dup_lines(spark, sf):
    return dedup.similar_to_original(notes(spark, sf))


@query()
def near_dup_diffs(spark, sf):
    n = notes(spark, sf)
    pairs = dedup.name_groups(n).where("not is_original").join(n.select("path", "content"), "path")
    pairs = pairs.join(n.select(F.col("path").alias("original"), F.col("content").alias("old")), "original")
    return dedup.diffs(pairs, "old", "content").select("path", "original", F.size("diff").alias("diff_lines"), F.md5(F.array_join("diff", "\n")).alias("diff_md5"))


# --- links -------------------------------------------------------------------------------------------------------------

LINKS = (
    "WITH " + NOTES_SQL + ", " + ATTACHMENTS_SQL + r""",
wiki AS (SELECT path, trim(split_part(unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)), '|', 1)) AS link FROM notes),
md AS (SELECT path, unnest(regexp_extract_all(content, '!?\[([^\]]*)\]\(([^)]+)\)', 1)) AS alt, unnest(regexp_extract_all(content, '!?\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM notes),
refs AS (SELECT path, rel_path FROM wiki JOIN attachments ON link = name WHERE NOT contains(lower(link), 'attachments/')
  UNION SELECT path, rel_path FROM (SELECT path, split_part(replace(regexp_split_to_array(link, '(?i)attachments/')[-1], '../', ''), '?', 1) AS rel_path
    FROM (SELECT path, link FROM wiki UNION ALL SELECT path, url FROM md) WHERE contains(lower(link), 'attachments/')) SEMI JOIN attachments USING (rel_path)),
dups AS (SELECT rel_path, first_value(rel_path) OVER w AS kept, row_number() OVER w = 1 AS is_kept FROM attachments WINDOW w AS (PARTITION BY hash ORDER BY size DESC, name, rel_path) QUALIFY count(*) OVER (PARTITION BY hash) > 1),
orphans AS (SELECT rel_path, name, size, rel_path IN (SELECT kept FROM dups WHERE NOT is_kept AND rel_path IN (SELECT rel_path FROM refs)) AS via_copy
  FROM attachments WHERE rel_path NOT IN (SELECT rel_path FROM refs) AND rel_path NOT IN (SELECT rel_path FROM dups WHERE NOT is_kept)) """
)


def vault(spark, sf) -> tuple[DataFrame, DataFrame]:
    return notes(spark, sf), attachments(spark, sf)


@query(LINKS + "SELECT path, link FROM wiki WHERE link <> ''")
def links_wiki(spark, sf):
    return references.wiki_links(notes(spark, sf))


@query(LINKS + "SELECT path, alt, url FROM md")
def links_md(spark, sf):
    return references.md_links(notes(spark, sf))


@query(LINKS + "SELECT path, rel_path FROM refs")
def refs_resolved(spark, sf):
    return references.references(*vault(spark, sf))


@query(LINKS + "SELECT rel_path, name, size, via_copy FROM orphans")
def orphans(spark, sf):
    return references.orphans(*vault(spark, sf))


#: How a note may hold a name; plain mentions in the text count as well.
MENTION = "CASE {i} % 5 WHEN 1 THEN {cat}(' see (file ', {i} + 1, '.png)') WHEN 2 THEN {cat}(' in Attachments/file ', {i} + 2, '.png') WHEN 3 THEN {cat}(' at img/file ', {i} + 3, '.png') ELSE ' file 3.png' END"


@query(LINKS + ", s AS (SELECT rel_path, name FROM orphans ORDER BY md5(rel_path), rel_path LIMIT (SELECT greatest(100, count(*) // 20) FROM orphans)), c AS (SELECT content || " + MENTION.format(i="doc_id", cat="concat") + """ AS content FROM notes)
 SELECT rel_path, EXISTS (SELECT 1 FROM c WHERE contains(content, '[[' || name || ']]') OR contains(content, '![[' || name || ']]') OR contains(content, '(' || name || ')') OR contains(content, 'Attachments/' || name) OR contains(content, rel_path)) AS mentioned FROM s""")
def orphans_verified(spark, sf):
    n, a = vault(spark, sf)
    mentions = n.withColumn("content", F.concat("content", F.expr(MENTION.format(i="doc_id", cat="concat"))))
    return references.verified_sample(mentions, references.orphans(n, a))


NOTE_LINKS = LINKS + r""", own AS (SELECT path, name FROM (SELECT path, unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)) AS rel_path FROM notes) JOIN attachments USING (rel_path)
  UNION SELECT path, string_split(url, 'Attachments/')[-1] FROM (SELECT path, unnest(regexp_extract_all(content, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS url FROM notes) WHERE contains(url, 'Attachments/')) """


@query(NOTE_LINKS + "SELECT path, name FROM own")
def note_attachments(spark, sf):
    return references.note_attachments(*vault(spark, sf))


@query(NOTE_LINKS + "SELECT path, count(*) AS attachments FROM own GROUP BY path")
def attachment_counts(spark, sf):
    return references.note_attachments(*vault(spark, sf)).groupBy("path").agg(F.count("*").alias("attachments"))


@query(NOTE_LINKS + r""", n AS (SELECT path, coalesce(nullif(regexp_extract(name, '^(.+) \(([0-9]+)\)\.md$', 1), ''), regexp_replace(name, '\.md$', '')) AS base, coalesce(try_cast(nullif(regexp_extract(name, '^(.+) \(([0-9]+)\)\.md$', 2), '') AS bigint), 0) AS number FROM notes),
 ng AS (SELECT path, base, row_number() OVER (PARTITION BY base ORDER BY number, path) = 1 AS is_original FROM n QUALIFY max(number) OVER (PARTITION BY base) > 0)
 SELECT base, name, min(path) AS path FROM own JOIN ng USING (path) GROUP BY base, name HAVING count(*) = 1 AND NOT bool_or(is_original)""")
def orphan_in_group(spark, sf):
    return references.group_orphans(*vault(spark, sf))


@query(LINKS + "SELECT path, count(*) FILTER (kind = 'wiki') AS wiki_links, count(*) FILTER (kind = 'md') AS md_links FROM (SELECT path, 'wiki' AS kind, link FROM wiki WHERE link <> '' UNION SELECT path, 'md', url FROM md) GROUP BY path")
def link_counts(spark, sf):
    return references.link_counts(notes(spark, sf))


@query(LINKS + r""", first AS (SELECT name, min(rel_path) AS rel_path FROM attachments WHERE ends_with(lower(name), '.png') GROUP BY name),
 e AS (SELECT path, split_part(unnest(regexp_extract_all(content, '!\[\[([^\]]+)\]\]', 1)), '|', 1) AS name FROM notes),
 u AS (SELECT path, unnest(regexp_extract_all(content, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS url FROM notes)
 SELECT path, rel_path FROM e JOIN first USING (name) WHERE ends_with(lower(name), '.png')
 UNION SELECT path, rel_path FROM (SELECT path, split_part(replace(regexp_split_to_array(url, '(?i)attachments/')[-1], '../', ''), '?', 1) AS rel_path FROM u
   WHERE ends_with(lower(url), '.png') AND contains(lower(url), 'attachments/')) SEMI JOIN attachments USING (rel_path)""")
def audio_embeds(spark, sf):
    """Embeds of .png stand in for audio."""
    return references.audio_embeds(*vault(spark, sf), ["png"])


@query("WITH " + NOTES_SQL + """ SELECT path, 1 AS renames, md5(replace(content, '![[file ' || doc_id || '.png|', '![[file ' || doc_id || '.jpg|')) AS content_md5 FROM notes WHERE doc_id % 6 = 0""")
def renamed_references(spark, sf):
    """Notes whose embed is an attachment; their addresses end with a query, not with a name."""
    n, a = vault(spark, sf)
    return references.renamed(n, a.select(F.col("name").alias("old"), F.regexp_replace("name", r"\.png$", ".jpg").alias("new"))).select("path", "renames", F.md5("new_content").alias("content_md5"))


@query(LINKS + "SELECT 'deduplicate' AS op, rel_path AS src_path, CASE WHEN NOT is_kept THEN 'duplicate of ' || kept END AS reason FROM dups WHERE NOT is_kept UNION ALL SELECT 'orphan', rel_path, 'no note refers to it' FROM orphans")
def attachment_cleanup_plan(spark, sf):
    """Duplicates that are not kept and orphans, as rows of one action plan."""
    n, a = vault(spark, sf)
    gone = dedup.keep_one(a, "rel_path").where("not is_kept")
    rows = plan.plan(gone, "deduplicate", "MOVE", "rel_path", group_key="hash", reason=F.concat(F.lit("duplicate of "), "kept"))
    rows = rows.unionByName(plan.plan(references.orphans(n, a), "orphan", "MOVE", "rel_path", reason=F.lit("no note refers to it")))
    return rows.select("op", "src_path", "reason")


@query("WITH " + NOTES_SQL + ", r AS (SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS n FROM notes) SELECT path AS src_path, '.trash/notes_20240101_000000/' || CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.md$', '') || '_' || cast(n AS varchar) || '.md' END AS dest_path FROM r")
def trash_collision_names(spark, sf):
    return plan.trash_plan(notes(spark, sf), "trash", "path", "notes", "20240101_000000", "test").select("src_path", "dest_path")


# --- conversations -----------------------------------------------------------------------------------------------------

ROLLUP = """WITH r AS (SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages, cast(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS bigint) AS user_chars,
  count(*) FILTER (role = 'assistant') AS assistant_messages, cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS assistant_chars
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
rollup_ AS (SELECT *, user_chars + assistant_chars AS total_chars, coalesce(user_chars::double / nullif(user_messages, 0), 0) AS avg_user, coalesce(assistant_chars::double / nullif(assistant_messages, 0), 0) AS avg_assistant FROM r) """


def rollup(spark, sf) -> DataFrame:
    return stats.conversation_rollup(table(spark, sf, "conversations"))


@query(ROLLUP + "SELECT * FROM rollup_")
def conv_rollup(spark, sf):
    return rollup(spark, sf)


@query(ROLLUP + "SELECT count(*) AS conversations, count(*) FILTER (user_messages <= 2) AS single_turn, count(*) FILTER (user_messages > 2) AS multi_turn, " + ", ".join(f"avg({c}) AS avg_{c}, cast(median({c}) AS double) AS median_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("user_messages", "assistant_messages", "user_chars", "assistant_chars", "total_chars")) + "".join(f", avg(avg_{r}) FILTER ({r}_messages > 0) AS avg_{r}_length, median(avg_{r}) FILTER ({r}_messages > 0) AS median_{r}_length" for r in ("user", "assistant")) + " FROM rollup_")
def conv_summary(spark, sf):
    return stats.conversation_summary(rollup(spark, sf))


@query(ROLLUP + ", k AS (SELECT total_chars AS value, row_number() OVER (ORDER BY total_chars) - 1 AS i, count(*) OVER () AS n FROM rollup_) SELECT cast(p AS integer) AS percent, value FROM k, (SELECT unnest([50, 75, 80, 90, 95, 99]) AS p) WHERE i = n * p // 100")
def conv_percentiles(spark, sf):
    return stats.nearest_rank(rollup(spark, sf), "total_chars")


@query(ROLLUP + "SELECT cast(lo AS integer) AS low, cast(hi AS integer) AS high, count(conv_id) AS conversations, 100.0::double * count(conv_id) / (SELECT count(*) FROM rollup_) AS pct FROM (VALUES (0, 1000), (1000, 5000), (5000, 10000), (10000, 20000), (20000, 999999)) b(lo, hi) LEFT JOIN rollup_ ON total_chars >= lo AND total_chars < hi GROUP BY lo, hi")
def conv_histogram(spark, sf):
    return stats.length_histogram(rollup(spark, sf))


@query(ROLLUP + """, c AS (SELECT strategy, total_chars,
  CASE WHEN user_messages <= 2 THEN least(user_chars::double, user_messages * u::double) + least(assistant_chars::double, assistant_messages * a::double)
  ELSE least(least(user_messages, m) * least(avg_user, u::double), user_chars::double) + least(least(assistant_messages, m) * least(avg_assistant, a::double), assistant_chars::double) END AS captured
  FROM rollup_, (VALUES ('current', 2000, 500, 3), ('conservative', 1000, 300, 3), ('aggressive', 3000, 800, 5), ('full_single', 999999, 500, 5)) s(strategy, u, a, m))
SELECT strategy, cast(sum(total_chars) AS bigint) AS total_chars, round(sum(captured), 3) AS captured_chars, round(100.0::double * sum(captured) / sum(total_chars), 6) AS coverage_pct FROM c GROUP BY strategy""")
def conv_coverage(spark, sf):
    return stats.coverage(rollup(spark, sf))


@query("""WITH ua AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS users, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT conv_id, role, turn, users, CASE WHEN users <= 2 THEN left(text, 10000) ELSE left(text, 3000) END AS t FROM ua WHERE users <= 2 OR rank <= 5),
o AS (SELECT conv_id, cast(max(users) AS bigint) AS user_messages, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_sample, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant_sample FROM k GROUP BY conv_id)
SELECT *, (length(user_sample) + length(assistant_sample)) // 4 AS token_estimate FROM o""")
def conv_prompt_sample(spark, sf):
    return stats.prompt_samples(table(spark, sf, "conversations"))


@query("WITH b AS (SELECT conv_id, length(text) + 1 AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, count(*) AS lines, cast(sum(n) AS bigint) AS chars FROM b WHERE before < 3000 GROUP BY conv_id")
def conv_preview_budget(spark, sf):
    return stats.previews(table(spark, sf, "conversations"))


@query("SELECT conv_id, role, count(*) AS messages FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role")
def conv_regex_messages(spark, sf):
    """Conversations rendered as transcripts and parsed again."""
    return curation.parsed_messages(curation.transcripts(table(spark, sf, "conversations"))).groupBy("conv_id", "role").agg(F.count("*").alias("messages"))


# --- reports and snapshots ---------------------------------------------------------------------------------------------

REPORT = "WITH " + REPORT_SQL + " "


@query(REPORT + "SELECT action, count(*) AS conversations, count(*) FILTER (has_framework) AS frameworks, round(avg(score), 6) AS avg_score FROM report GROUP BY action")
def report_actions(spark, sf):
    return reports.actions(report(spark, sf))


@query(REPORT + "SELECT path, action FROM report WHERE reasoning IS NOT DISTINCT FROM 'Error parsing LLM response'")
def report_failed(spark, sf):
    return reports.failed(report(spark, sf)).select("path", "action")


@query(REPORT + ", n AS (SELECT path, 'keep' AS action, 80.0::double AS score FROM report WHERE reasoning = 'Error parsing LLM response') SELECT r.path, coalesce(n.action, r.action) AS action, coalesce(n.score, r.score) AS score FROM report r LEFT JOIN n USING (path)")
def report_upsert(spark, sf):
    r = report(spark, sf)
    return reports.upsert(r, reports.failed(r).select("path", F.lit("keep").alias("action"), F.lit(80.0).alias("score")).distinct(), "input_tokens").select("path", "action", "score")


@query(REPORT + "SELECT path, score, CASE WHEN score >= 70 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS band FROM report WHERE action = 'review'")
def report_review_bands(spark, sf):
    return report(spark, sf).where("action = 'review'").select("path", "score", reports.score_band(F.col("score")).alias("band"))


@query(REPORT + ", t AS (SELECT count(*) AS n, sum(input_tokens) * 0.15::double / 1e6 + sum(output_tokens) * 0.6::double / 1e6 AS cost, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(seconds) AS s FROM report) SELECT n AS conversations, cast(i AS bigint) AS input_tokens, cast(o AS bigint) AS output_tokens, round(cost, 9) AS cost, s AS seconds, round(round(cost, 9) / n, 9) AS avg_cost, round(s / n, 9) AS avg_seconds, round(cost / n * 1000, 6) AS projected_cost FROM t")
def token_estimate_cost(spark, sf):
    return reports.costs(report(spark, sf), 1000)


@query(REPORT + "SELECT path AS src_path, 'archive/' || regexp_replace(path, '^src1/', '') AS dest_path FROM report WHERE action = 'archive'")
def archive_plan(spark, sf):
    return plan.archive_plan(report(spark, sf).where("action = 'archive'"), "path", "src1", "archive").select("src_path", "dest_path")


@query(REPORT + "SELECT path, CASE WHEN cast(regexp_extract(path, '([0-9]+)\\.md$', 1) AS bigint) % 2 = 0 THEN 'DELETE' ELSE 'MISSING' END AS status FROM report WHERE action = 'archive'")
def delete_status(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return reports.existing(report(spark, sf), docs)


SYNC = "WITH " + NOTES_SQL + ", " + BACKUP_SQL + ", source AS (SELECT path, md5(content) AS hash, length(content) AS size FROM notes), diff AS (SELECT coalesce(s.path, b.path) AS path, CASE WHEN s.hash IS NULL THEN 'orphan' WHEN b.hash IS NULL THEN 'new' WHEN s.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS status, size FROM source s FULL JOIN backup b ON s.path = b.path) "


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    n = notes(spark, sf)
    return n.select("path", F.md5("content").alias("hash")), backup(n)


@query(SYNC + "SELECT path, status FROM diff")
def sync_diff(spark, sf):
    return reports.snapshot_diff(*snapshots(spark, sf))


@query(SYNC + "SELECT path FROM diff WHERE status = 'orphan'")
def sync_orphans(spark, sf):
    return reports.snapshot_orphans(*snapshots(spark, sf))


@query(SYNC + "SELECT status, count(*) AS files, cast(coalesce(sum(size) FILTER (status IN ('new', 'modified')), 0) AS bigint) AS copied_size FROM diff GROUP BY status")
def sync_counters(spark, sf):
    sizes = notes(spark, sf).select("path", F.length("content").cast("long").alias("size"))
    return reports.snapshot_counters(reports.snapshot_diff(*snapshots(spark, sf)), sizes)


# --- tags, languages, archive ------------------------------------------------------------------------------------------

TAGS = (
    "WITH " + NOTES_SQL + f", ok AS (SELECT unnest([{quoted(vocab.APPROVED_TAGS)}]) AS tag), dict AS (SELECT unnest([{quoted(vocab.TAG_MAPPING)}]) AS tag, unnest(["
    + ", ".join("NULL" if v is None else f"'{v}'" for v in vocab.TAG_MAPPING.values()) + "]) AS target), "
    + r"""l AS (SELECT path, content, regexp_extract(content, '(?m)^tags:\s*\[[^\]]+\]') AS line FROM notes),
t0 AS (SELECT path, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM (SELECT path, string_split(regexp_extract(line, '\[([^\]]+)\]', 1), ',') AS a FROM l WHERE line <> '')),
t AS (SELECT path, i, trim(trim(raw), '''"') AS tag FROM t0),
rows_ AS (SELECT path, i, t.tag, CASE WHEN ok.tag IS NOT NULL THEN t.tag WHEN dict.tag IS NOT NULL THEN dict.target WHEN topic.tag IS NOT NULL THEN topic.tag END AS mapped
  FROM t LEFT JOIN ok ON ok.tag = t.tag LEFT JOIN dict ON dict.tag = t.tag LEFT JOIN ok topic ON topic.tag = 'topic/' || t.tag WHERE t.tag <> '') """
)


@query(TAGS + "SELECT path, tag, mapped FROM rows_")
def tags_normalise(spark, sf):
    return curation.tag_rows(notes(spark, sf))


@query(TAGS + "SELECT * FROM (SELECT mapped AS tag, count(DISTINCT path) AS uses, 'kept' AS status FROM rows_ WHERE mapped IS NOT NULL GROUP BY 1 ORDER BY uses DESC, tag LIMIT 100) UNION ALL SELECT * FROM (SELECT tag, count(*) AS uses, 'removed' AS status FROM rows_ WHERE mapped IS NULL GROUP BY 1 ORDER BY uses DESC, tag LIMIT 100)")
def tags_frequency(spark, sf):
    return curation.tag_frequency(notes(spark, sf))


@query(TAGS + ", y AS (SELECT path, coalesce('tags:' || chr(10) || '  - ' || string_agg(DISTINCT mapped, chr(10) || '  - ' ORDER BY mapped), 'tags: []') AS yaml, count(DISTINCT mapped) AS k, count(*) FILTER (mapped IS NULL) AS r FROM rows_ GROUP BY path) SELECT path, cast(k AS integer) AS n_kept, cast(r AS integer) AS n_removed, yaml, md5(replace(content, line, yaml)) AS content_md5 FROM y JOIN l USING (path)")
def tags_render(spark, sf):
    return curation.normalised_notes(notes(spark, sf)).select("path", "n_kept", "n_removed", "yaml", F.md5("new_content").alias("content_md5"))


@query(TAGS + "SELECT count(DISTINCT path) AS notes, count(DISTINCT (path, mapped)) FILTER (mapped IS NOT NULL) AS kept, count(*) FILTER (mapped IS NULL) AS removed FROM rows_")
def tags_totals(spark, sf):
    return curation.tag_totals(notes(spark, sf))


SIGNS = f"""len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), [{quoted(vocab.SPANISH_WORDS)}])) + len(regexp_extract_all(text, '[{vocab.SPANISH_CHARACTERS}]')) AS spanish,
  len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), [{quoted(vocab.ENGLISH_WORDS)}])) AS english"""


@query("SELECT doc_id, cast(spanish AS integer) AS spanish, cast(english AS integer) AS english FROM (SELECT doc_id, " + SIGNS + " FROM documents)")
def lang_indicators(spark, sf):
    es, en = text.indicators(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", es.cast("int").alias("spanish"), en.cast("int").alias("english"))


@query("WITH s AS (SELECT doc_id, length(text) AS n, " + SIGNS + """ FROM documents) SELECT doc_id,
  CASE WHEN n < 50 OR spanish + english <= 5 THEN NULL WHEN spanish > english * 1.5::double THEN 'es' WHEN english > spanish * 1.5::double THEN 'en' END AS lang,
  CASE WHEN n < 50 OR spanish + english <= 5 THEN 0 WHEN spanish > english * 1.5::double THEN least(0.9, round(spanish::double / (spanish + english), 9)) WHEN english > spanish * 1.5::double THEN least(0.9, round(english::double / (spanish + english), 9)) ELSE 0 END::double AS confidence FROM s""")
def lang_decision(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("prob"))
    return language.decided(docs, "text").select("doc_id", "lang", F.round("confidence", 9).alias("confidence"))


HELD_OUT = "left(md5(cast(doc_id AS varchar)), 1) < '3'"
WORDS_OF = r"' ' || trim(regexp_replace(lower({}), '([^\p{{L}}]|[\x{{10000}}-\x{{10FFFF}}])+', ' ', 'g')) || ' '"
GRAMS_OF = "unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))"


def model_sql(key: str = "doc_id", asked: str = "(SELECT doc_id, text AS asked FROM documents)", only: str = "true", before: str = "") -> str:
    """The detector in SQL: fitted on the documents outside the held-out fold, whole numbers throughout, and asked for
    `asked` (key, asked). Ends with best (key, best, prob); behind t, the documents."""
    return f"""WITH {before}{", " if before else ""}t AS (SELECT doc_id, lang, {HELD_OUT} AS held_out, {WORDS_OF.format("text")} AS s FROM documents),
 g AS (SELECT lang, {GRAMS_OF} AS gram FROM t WHERE NOT held_out AND lang IS NOT NULL), c AS (SELECT lang, gram, count(*) AS c FROM g GROUP BY ALL),
 v AS (SELECT count(DISTINCT gram) AS v FROM c), n AS (SELECT lang, count(*) AS n FROM t WHERE NOT held_out AND s IS NOT NULL AND lang IS NOT NULL GROUP BY lang),
 l AS (SELECT lang, t + v AS size, floor(ln(1.0::double / (t + v)) * 1e6::double + 0.5) AS unseen, floor(ln(n::double / (SELECT sum(n) FROM n)) * 1e6::double + 0.5) AS prior FROM (SELECT lang, sum(c) AS t FROM c GROUP BY lang) JOIN n USING (lang), v),
 gain AS MATERIALIZED (SELECT gram, lang, floor(ln((c + 1)::double / size) * 1e6::double + 0.5) - unseen AS gain FROM c JOIN l USING (lang)),
 k AS MATERIALIZED (SELECT {key}, gram, count(*) AS k FROM (SELECT {key}, {GRAMS_OF} AS gram FROM (SELECT {key}, {WORDS_OF.format("asked")} AS s FROM {asked})) GROUP BY ALL),
 whole AS (SELECT {key}, sum(k) AS n FROM k GROUP BY {key}), hits AS (SELECT {key}, lang, sum(k * gain) AS hit FROM k JOIN gain USING (gram) GROUP BY ALL),
 scores AS (SELECT w.{key}, l.lang, prior + n * unseen + coalesce(hit, 0) AS score FROM whole w, l LEFT JOIN hits h ON h.{key} = w.{key} AND h.lang = l.lang),
 p AS (SELECT {key}, lang, exp((score - max(score) OVER (PARTITION BY {key})) / 1e6::double) AS e FROM scores), q AS (SELECT {key}, lang, e / sum(e) OVER (PARTITION BY {key}) AS p FROM p),
 guess AS (SELECT {key}, lang AS best, p AS prob FROM q WHERE {only} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY p DESC, lang) = 1), best AS MATERIALIZED (SELECT * FROM guess WHERE prob >= 0.1) """


#: The decision in SQL, from n3 (text, spanish, english, best, prob).
DECISION = """w AS (SELECT *, length(text) < 50 OR text IS NULL AS short, prob < 0.7 AND spanish + english > 5 AND spanish > english * 1.5::double AS es_wins, prob < 0.7 AND spanish + english > 5 AND english > spanish * 1.5::double AS en_wins,
  best = 'es' AND spanish >= english OR best = 'en' AND english >= spanish AS agrees FROM n3),
 n4 AS MATERIALIZED (SELECT *, CASE WHEN short THEN NULL WHEN es_wins THEN 'es' WHEN en_wins THEN 'en' WHEN prob >= 0.7 OR best IS NULL OR agrees THEN best WHEN spanish > english * 2 THEN 'es' WHEN english > spanish * 2 THEN 'en' ELSE best END AS lang,
  CASE WHEN short THEN 0 WHEN es_wins THEN least(0.9, spanish::double / (spanish + english)) WHEN en_wins THEN least(0.9, english::double / (spanish + english)) WHEN prob >= 0.7 OR best IS NULL THEN prob
   WHEN agrees THEN greatest(prob, 0.6) WHEN spanish > english * 2 OR english > spanish * 2 THEN 0.6 ELSE prob END::double AS conf FROM w)"""


def model(spark, sf) -> language.LanguageModel:
    docs = table(spark, sf, "documents")
    return language.fit(docs.where(~F.expr("left(md5(cast(doc_id AS string)), 1) < '3'")))


@query(model_sql() + "SELECT doc_id, held_out, t.lang, best, round(coalesce(prob, 0), 6) AS prob FROM t LEFT JOIN best USING (doc_id)")
def lang_detector(spark, sf):
    """Each document's language by a model of character trigrams that has not seen the held-out ones."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", F.expr("left(md5(cast(doc_id AS string)), 1) < '3'").alias("held_out"))
    return model(spark, sf).detect(docs, "doc_id", "text").select("doc_id", "held_out", "lang", "best", F.round("prob", 6).alias("prob"))


@query(model_sql() + "SELECT t.lang, count(*) AS documents, count(*) FILTER (best = t.lang) AS recognised, round(100.0::double * count(*) FILTER (best = t.lang) / count(*), 6) AS pct FROM t LEFT JOIN best USING (doc_id) WHERE held_out GROUP BY t.lang")
def lang_detector_accuracy(spark, sf):
    """Held-out documents by language, and those that the detector recognises."""
    right = F.count_if(F.col("best") == F.col("lang"))
    by = lang_detector(spark, sf).where("held_out").groupBy("lang").agg(F.count("*").alias("documents"), right.alias("recognised"))
    return by.withColumn("pct", F.round(100.0 * F.col("recognised") / F.col("documents"), 6))


@query(model_sql(only="lang IN ('en', 'es')") + ", n3 AS (SELECT doc_id, text, best, coalesce(prob, 0) AS prob, " + SIGNS + " FROM documents LEFT JOIN best USING (doc_id)), " + DECISION + " SELECT doc_id, lang, round(conf, 6) AS confidence FROM n4")
def lang_decision_model(spark, sf):
    """The language decision with a model behind it, which offers English and Spanish alone."""
    docs = model(spark, sf).detect(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ["en", "es"])
    return language.decided(docs, "text").select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


def cleaned(text: str) -> str:
    """SQL of a note's body without markup; the fixture has no curator's summary."""
    for pattern, new in (
        (r"(?s)```.*?```", ""), (r"(?s)~~~.*?~~~", ""), (r"`[^`]+`", ""), (r"https?://\S+", ""), (r"\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"<[^>]+>", ""),
        (r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"!\[\[.*?\]\]", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\s+", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"trim({text}, ' ')"


#: Notes with their frontmatter and plain text in SQL, and what a run makes of n3, these with best and prob.
LANG_NOTES = (
    NOTES_SQL + r", n0 AS (SELECT path, n.doc_id, content, d.lang AS own, CASE WHEN n.doc_id % 10 = 9 THEN '' ELSE regexp_extract(content, '(?s)^(---.*?\n---\n)', 1) END AS front FROM notes n JOIN documents d USING (doc_id)),"
    " n1 AS MATERIALIZED (SELECT *, " + cleaned("substr(content, length(front) + 1)") + " AS text FROM n0), n2 AS MATERIALIZED (SELECT *, " + SIGNS + " FROM n1)"
)
LANG_STATUS = DECISION + """, tagged AS (SELECT *, CASE WHEN doc_id % 3 < 2 AND front <> '' AND own IN ('en', 'es') THEN own END AS tag FROM n4),
 n5 AS (SELECT *, CASE WHEN front = '' THEN 'no_frontmatter' WHEN short THEN 'short' WHEN lang IS NULL OR conf < 0.5 THEN 'uncertain' WHEN tag = lang THEN 'correct' WHEN tag IS NOT NULL THEN 'changed' ELSE 'added' END AS status FROM tagged),
 runs AS (SELECT *, CASE status WHEN 'changed' THEN replace(front, 'lang/' || tag, 'lang/' || lang)
  WHEN 'added' THEN CASE WHEN doc_id % 3 = 1 THEN front || '  - lang/' || lang || chr(10) ELSE replace(front, ']' || chr(10), ', ' || chr(39) || 'lang/' || lang || chr(39) || ']' || chr(10)) END END || substr(content, length(front) + 1) AS new_content FROM n5) """
FUNNEL = """SELECT count(*) AS notes_scanned, count(*) FILTER (status = 'no_frontmatter') AS skipped_no_frontmatter, count(*) FILTER (status = 'short') AS skipped_short, count(*) FILTER (status = 'uncertain') AS skipped_uncertain,
 count(*) FILTER (status IN ('correct', 'changed', 'added') AND lang = 'en') AS detected_en, count(*) FILTER (status IN ('correct', 'changed', 'added') AND lang <> 'en') AS detected_es, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'added') AS added,
 count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status IN ('added', 'changed')) AS fixed, cast(0 AS bigint) AS errors FROM runs"""


@query(model_sql("path", "(SELECT path, text AS asked FROM n2)", "lang IN ('en', 'es')", LANG_NOTES) + ", n3 AS (SELECT n2.*, best, coalesce(prob, 0) AS prob FROM n2 LEFT JOIN best USING (path)), " + LANG_STATUS + FUNNEL)
def lang_funnel_model(spark, sf):
    """The counters of a run whose detector is the model."""
    return curation.language_funnel(notes(spark, sf), detector=lambda rows: model(spark, sf).detect(rows, "path", "plain", ["en", "es"]))


@query("WITH " + LANG_NOTES + ", n3 AS (SELECT *, NULL AS best, 0 AS prob FROM n2), " + LANG_STATUS + FUNNEL)
def lang_funnel(spark, sf):
    return curation.language_funnel(notes(spark, sf))


@query("WITH " + LANG_NOTES + ", n3 AS (SELECT *, NULL AS best, 0 AS prob FROM n2), " + LANG_STATUS + "SELECT path, lang, round(conf, 9) AS confidence, tag, status, md5(new_content) AS content_md5 FROM runs")
def lang_tag_upsert(spark, sf):
    return curation.language_rows(notes(spark, sf)).select("path", "lang", "confidence", "tag", "status", F.md5("new_content").alias("content_md5"))


ARCHIVE = "WITH " + NOTES_SQL + ", plain AS (SELECT path, name, content, lower(left(content, 2000)) AS low FROM notes WHERE NOT starts_with(content, '---' || chr(10))) "
ARCHIVE_LANG = "CASE WHEN len(regexp_extract_all(low, '[áéíóúñü]')) >= 3 OR " + " + ".join(f"contains(' ' || low || ' ', ' {w} ')::integer" for w in vocab.ARCHIVE_SPANISH_WORDS) + " >= 5 OR regexp_matches(low, '[¿¡]') THEN 'lang/es' ELSE 'lang/en' END"
ARCHIVE_USE = "greatest(0.3, least(0.9, 0.5::double + CASE WHEN length(content) > 5000 THEN 0.15 WHEN length(content) < 500 THEN -0.15 ELSE 0 END::double))"
ARCHIVE_TOPICS = "list_sort(list_distinct(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{t}' END" for t, words in vocab.ARCHIVE_TOPICS.items()) + "], lambda x: x IS NOT NULL)))"


@query(ARCHIVE + "SELECT path, " + ARCHIVE_LANG + " AS lang FROM plain")
def archive_language(spark, sf):
    return curation.archive_rows(notes(spark, sf), "2024-01-01").select("path", "lang")


@query(ARCHIVE + "SELECT path, 'type/note' AS kind, array_to_string(" + ARCHIVE_TOPICS + ", ',') AS topics FROM plain")
def archive_type_topics(spark, sf):
    return curation.archive_rows(notes(spark, sf), "2024-01-01").select("path", "kind", "topics")


@query(ARCHIVE + "SELECT path, round(" + ARCHIVE_USE + ", 6) AS usefulness FROM plain")
def archive_usefulness(spark, sf):
    return curation.archive_rows(notes(spark, sf), "2024-01-01").select("path", "usefulness")


@query(ARCHIVE + "SELECT topic, count(*) AS notes FROM (SELECT unnest(" + ARCHIVE_TOPICS + ") AS topic FROM plain) GROUP BY topic ORDER BY notes DESC, topic LIMIT 10")
def archive_topic_counts(spark, sf):
    return curation.archive_topics_top(notes(spark, sf))


ARCHIVE_SHOWN = "CASE " + " ".join(f"WHEN u {op} {bound}::double THEN '{shown}'" for op, bound, shown in vocab.SCORE_TEXT) + " ELSE '0.9' END"


@query(ARCHIVE + ", s AS (SELECT *, " + ARCHIVE_USE + " AS u, list_sort(list_distinct(list_concat(['type/note', 'status/archived', " + ARCHIVE_LANG + "], " + ARCHIVE_TOPICS + "))) AS tags FROM plain) SELECT path, md5(array_to_string(['---', 'date: \"2024-01-01\"', 'tags:', '  - ' || array_to_string(tags, chr(10) || '  - '), 'usefulness: ' || " + ARCHIVE_SHOWN + ", '---', '', '## My Thoughts', '', '*Add your thoughts here*', '', '## Related Notes', '', '*No related notes identified*', '', '---', '', content], chr(10))) AS content_md5 FROM s")
def archive_frontmatter(spark, sf):
    return curation.archive_rows(notes(spark, sf), "2024-01-01").select("path", F.md5("new_content").alias("content_md5"))


@query(ARCHIVE + "SELECT lang, count(*) AS notes, round(avg(u), 6) AS avg_usefulness FROM (SELECT " + ARCHIVE_LANG + " AS lang, " + ARCHIVE_USE + " AS u FROM plain) GROUP BY lang")
def archive_totals(spark, sf):
    return curation.archive_totals(notes(spark, sf))


#: The hashtags that the notes' last line has; those with a slash, in code or in the text of a document are none.
TAGGED = "WITH " + NOTES_SQL + """, h AS (SELECT path, content, unnest([strpos(content, '#general and #topic/risk plus') - 1, length(content) - length('#off-topic') - 1]) AS start, unnest(['general', 'off-topic']) AS tag FROM notes WHERE content IS NOT NULL) """


@query(TAGGED + "SELECT path, cast(start AS integer) AS start, cast(start + length(tag) + 1 AS integer) AS end, tag FROM h")
def hashtags_found(spark, sf):
    return curation.hashtag_rows(notes(spark, sf))


@query(TAGGED + "SELECT path, cast(start AS integer) AS start, cast(start + length(tag) + 1 AS integer) AS end, tag FROM h")
def hashtags_lateral(spark, sf):
    """The same by the table function."""
    return notes(spark, sf).lateralJoin(arrow.hashtag_table()(F.col("content").outer())).select("path", "start", "end", "tag")


@query(TAGGED + "SELECT tag, count(*) AS uses, count(DISTINCT path) AS notes FROM h GROUP BY tag ORDER BY uses DESC, tag LIMIT 30")
def hashtags_top30(spark, sf):
    return curation.hashtag_frequency(notes(spark, sf))


@query("WITH " + NOTES_SQL + " SELECT path, md5(replace(replace(content, '#general and #topic/risk plus', '`#general` and #topic/risk plus'), '#off-topic' || chr(10), '`#off-topic`' || chr(10))) AS content_md5 FROM notes WHERE content IS NOT NULL")
def hashtags_escaped(spark, sf):
    return curation.escaped_notes(notes(spark, sf)).select("path", F.md5("new_content").alias("content_md5"))


@query("WITH " + NOTES_SQL + """ SELECT path, CASE WHEN doc_id % 10 <> 9 THEN '"Doc ' || doc_id || '"' END AS title, cast(CASE WHEN doc_id % 10 <> 9 THEN strpos(substr(content, 4), '---') + 5 ELSE 0 END AS integer) AS dash_end,
 CASE WHEN doc_id % 10 <> 9 THEN 'Doc ' || doc_id END AS quoted_title, 'Note ' || doc_id // 4 AS heading FROM notes""")
def frontmatter_fields(spark, sf):
    n = notes(spark, sf)
    return n.select("path", F.element_at(text.frontmatter_map(F.col("content")), "title").alias("title"), text.any_dash_end(F.col("content")).cast("int").alias("dash_end"), text.quoted_field(F.col("content"), "title").alias("quoted_title"), text.title(F.col("content"), F.col("name")).alias("heading"))


# --- paths, sections, agents, JSON -------------------------------------------------------------------------------------


#: The paths of notes in SQL: seven kinds in a row, the first of equal ones, below /vault.
FOUND_PATHS = "WITH " + NOTES_SQL + r""", lists AS (SELECT path, list_concat(list_concat(list_concat(list_transform(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1), lambda x: split_part(trim(x), '|', 1)), regexp_extract_all(content, '\((/[^)]+)\)', 1)), list_concat(regexp_extract_all(content, '`(/[^`]+)`', 1),
  list_transform(regexp_extract_all(content, '(?m)^[ \t]*(/.*)$', 1), lambda x: regexp_replace(trim(x), '[,.]+$', '')))), list_concat(list_concat(regexp_extract_all(content, '(/Users[^\s)\]]+|/[^\s)\]]+)', 1), list_filter(regexp_extract_all(content, '<([^>]+)>', 1), lambda x: contains(x, '/') OR regexp_matches(x, '\.[A-Za-z0-9]{2,6}$'))),
  regexp_extract_all(content, '(?i)\b([^\s)\]"'']+\.(?:""" + text.EXTENSIONS + r"""))\b', 1))) AS a FROM notes),
 each AS (SELECT path, trim(unnest(a)) AS found, generate_subscripts(a, 1) AS i FROM lists), firsts AS (SELECT path, found, min(i) AS i FROM each WHERE found <> '' GROUP BY ALL),
 resolved AS (SELECT path, found, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ordinal, '/vault/' || regexp_replace(found, '^/+', '') AS resolved FROM firsts) """


@query(FOUND_PATHS + "SELECT path, cast(min(ordinal) AS integer) AS ordinal, arg_min(found, ordinal) AS found, resolved FROM resolved GROUP BY path, resolved")
def paths_extracted(spark, sf):
    return curation.path_rows(notes(spark, sf), "/vault")


@query(LINKS + "SELECT DISTINCT path, '/vault/' || link AS resolved FROM wiki WHERE link <> ''")
def paths_wiki_only(spark, sf):
    return curation.path_rows(notes(spark, sf), "/vault", "only").select("path", "resolved")


@query(LINKS + ", f AS (SELECT path, min(i) AS i, link FROM (SELECT path, generate_subscripts(a, 1) AS i, trim(split_part(unnest(a), '|', 1)) AS link FROM (SELECT path, regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1) AS a FROM notes)) WHERE link <> '' GROUP BY path, link) SELECT path, '/vault/' || link AS resolved FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) <= 1")
def paths_limited(spark, sf):
    return curation.path_rows(notes(spark, sf), "/vault", "only", limit=1).select("path", "resolved")


@query(FOUND_PATHS + ", " + ATTACHMENTS_SQL + r""", files AS (SELECT '/vault/Attachments/' || rel_path AS abs_path, name FROM attachments),
 urls AS (SELECT path, unnest(regexp_extract_all(content, '!?\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM notes), f AS (SELECT path, resolved FROM resolved UNION SELECT path, '/vault/' || replace(split_part(url, '?', 1), '../', '') FROM urls)
 SELECT DISTINCT path, coalesce(e.abs_path, m.abs_path, resolved) AS resolved FROM f LEFT JOIN files e ON e.abs_path = resolved LEFT JOIN files m ON e.abs_path IS NULL AND m.name = string_split(resolved, '/')[-1]""")
def basename_match(spark, sf):
    n = notes(spark, sf)
    known = attachments(spark, sf).select(F.concat(F.lit("/vault/Attachments/"), "rel_path").alias("abs_path"))
    found = references.md_links(n).select("path", text.resolved_path(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), "/vault/notes").alias("resolved"))
    return curation.matched_paths(curation.path_rows(n, "/vault").select("path", "resolved").unionByName(found), known)


@query("WITH " + ATTACHMENTS_SQL + """, files AS (SELECT '/vault/Attachments/' || rel_path AS abs_path, name FROM attachments), d AS (SELECT doc_id, source, cast(doc_id AS varchar) AS i, cast(doc_id // 10 AS varchar) AS t FROM documents),
 f AS (SELECT source AS path, unnest(['/vault/Attachments/img/file ' || i || '.png', '/vault/file ' || t || '?.png', '/vault/lost ' || i || '.png', '/vault/x/[!a-e]ile ' || t || '[2-4].p*']) AS resolved FROM d)
 SELECT DISTINCT path, coalesce(e.abs_path, m.abs_path, resolved) AS resolved FROM (SELECT DISTINCT path, resolved FROM f) LEFT JOIN files e ON e.abs_path = resolved LEFT JOIN files m ON e.abs_path IS NULL AND m.name GLOB string_split(resolved, '/')[-1]""")
def basename_globs(spark, sf):
    """Missing paths whose names are patterns, matched with every file of such a name."""
    docs, i, t = table(spark, sf, "documents"), F.col("doc_id").cast("string"), F.expr("cast(doc_id div 10 as string)")
    asked = F.array(F.concat(F.lit("/vault/Attachments/img/file "), i, F.lit(".png")), F.concat(F.lit("/vault/file "), t, F.lit("?.png")), F.concat(F.lit("/vault/lost "), i, F.lit(".png")), F.concat(F.lit("/vault/x/[!a-e]ile "), t, F.lit("[2-4].p*")))
    files = attachments(spark, sf).select(F.concat(F.lit("/vault/Attachments/"), "rel_path").alias("abs_path"))
    return curation.matched_paths(docs.select(F.col("source").alias("path"), F.explode(asked).alias("resolved")).distinct(), files)


@query("WITH " + PATHS_SQL + " SELECT doc_id, rel_path FROM paths ORDER BY rel_path, doc_id LIMIT 100")
def sorted_scan(spark, sf):
    return stats.sorted_scan(paths(spark, sf).select("doc_id", "rel_path"), "rel_path", "doc_id", limit=100)


@query("WITH " + PATHS_SQL + " SELECT doc_id, rel_path, 'agent' AS kind FROM paths WHERE regexp_matches(rel_path, '^\\.claude/agents/[^/]*\\.md$')")
def agent_files(spark, sf):
    return curation.agent_files(paths(spark, sf).select("doc_id", "rel_path"))


@query("WITH " + NOTES_SQL + """, c AS (SELECT path, regexp_replace(content, '^#\\s+[^\\n]+\\n', '') AS c FROM notes), e AS (SELECT *, position(chr(10) IN substr(c, 3000)) AS p FROM c)
SELECT path, md5(CASE WHEN p > 0 THEN left(c, 3000 + p - 2) || chr(10) || chr(10) || '[... conversation continues ...]' ELSE c END) AS preview_md5 FROM e""")
def note_previews(spark, sf):
    return notes(spark, sf).select("path", F.md5(text.preview(F.col("content"))).alias("preview_md5"))


@query("SELECT doc_id, 'Doc ' || doc_id AS title FROM documents")
def shown_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shown_title(F.concat(F.lit("Title: Doc "), F.col("doc_id").cast("string"))).alias("title"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run, strftime(ts, '%Y-%m-%d') AS day FROM events")
def time_stamps(spark, sf):
    run, day = text.stamps(F.col("ts"))
    return table(spark, sf, "events").select("event_id", run.alias("run"), day.alias("day"))


def chapters(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    body = F.concat(F.lit('---\ntitle: "Chapter '), F.col("doc_id").cast("string"), F.lit('"\n---\n## Chapter Overview\n\n'), F.col("text"), F.lit("\n\n## Key Arguments\n\n- **first** a\n- **second** b\n\n## Key Concepts\n\n### one\n\n### two\n"), F.when(F.col("doc_id") % 3 == 0, "![[x diagram.png]]\n").otherwise(""))
    return docs.select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("path"), body.alias("content"))


def book_chapters(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    body = F.concat(F.lit('---\ntitle: "Chapter '), F.col("doc_id").cast("string"), F.lit('"\n'), F.when(F.col("doc_id") % 2 == 0, F.lit("book: Tome\n")).otherwise(""), F.lit("---\n## Chapter Overview\n\n"), F.replace(F.replace("text", F.lit("\n## "), F.lit("\n# ")), F.lit("\n---"), F.lit("\n--")), F.lit("\n\n## Key Arguments\n\n- **first** a\n- **second** b\n\n## Core Concepts\n\n"), F.when(F.col("doc_id") % 5 != 0, "### one\n\n### two\n").otherwise("none\n"), F.when(F.col("doc_id") % 3 == 0, "![[x diagram.png]]\n").otherwise(""))
    return docs.select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("path"), body.alias("content"))


CHAPTERS = """WITH c AS (SELECT doc_id, trim(replace(replace(text, chr(10) || '## ', chr(10) || '# '), chr(10) || '---', chr(10) || '--'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS overview FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)!\\[\\[.*diagram.*\\]\\]|!\\[.*diagram.*\\]\\(.*\\)|!\\[\\[.*\\.excalidraw.*\\]\\]|```mermaid')) """


@query(CHAPTERS + """SELECT 'c' || doc_id AS path, 'Chapter ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Tome' ELSE 'Book' END AS book, 2 AS points, CASE WHEN doc_id % 5 <> 0 THEN 2 ELSE 0 END AS headers,
 md5('Create a professional concept map infographic summarizing:' || chr(10) || chr(10) || 'CHAPTER: Chapter ' || doc_id || chr(10) || 'FROM: ' || CASE WHEN doc_id % 2 = 0 THEN 'Tome' ELSE 'Book' END || chr(10) || chr(10) || 'OVERVIEW:' || chr(10) || overview[1:400]
 || chr(10) || chr(10) || 'KEY CONCEPTS TO VISUALIZE:' || chr(10) || CASE WHEN doc_id % 5 <> 0 THEN '- one' || chr(10) || '- two' ELSE '- first' || chr(10) || '- second' END || chr(10) || chr(10) || 'MAIN ARGUMENTS:' || chr(10) || '- first' || chr(10) || '- second' || chr(10) || chr(10)
 || 'Create a concept map showing relationships between these ideas. Use arrows and connections to show how concepts relate. Place the chapter title prominently at top.' || chr(10) || chr(10) || chr(10)) AS prompt_md5 FROM c WHERE doc_id % 3 <> 0""")
def chapter_prompts(spark, sf):
    return curation.chapter_prompts(book_chapters(spark, sf)).select("path", "title", "book", "points", "headers", F.md5("prompt").alias("prompt_md5"))


@query("SELECT count(*) AS chapters, count(*) FILTER (doc_id % 3 = 0) AS with_diagram, count(*) FILTER (doc_id % 3 <> 0) AS to_make, cast(0 AS bigint) AS no_content FROM documents")
def chapter_totals(spark, sf):
    return curation.chapter_totals(book_chapters(spark, sf))


@query("""SELECT 'c' || doc_id AS path, md5(array_to_string(['---', 'title: "Chapter ' || doc_id || '"', '---', '## Chapter Overview', '', '![[c' || doc_id || '.png]]', '', text, '', '## Key Arguments', '', '- **first** a', '- **second** b', '', '## Key Concepts', '', '### one', '', '### two', CASE WHEN doc_id % 3 = 0 THEN '![[x diagram.png]]' || chr(10) ELSE '' END], chr(10))) AS content_md5 FROM documents WHERE text IS NOT NULL""")
def insert_embed(spark, sf):
    rows = chapters(spark, sf)
    return rows.select("path", F.md5(text.with_embed(F.col("content"), F.concat(F.lit("![["), text.safe_name(F.col("path")), F.lit(".png]]")))).alias("content_md5"))


def agents(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit("---\n"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("name: agent-"), i, F.lit("\n"))).otherwise(""), F.when(F.col("doc_id") % 11 == 0, "description: bare\nloose line\nmodel: ").otherwise('description: "does <example> things"\nmodel: '), F.when(F.col("doc_id") % 5 == 0, "gpt").otherwise("opus"), F.lit("\nskills: alpha, beta\n---\n"), F.when(F.col("doc_id") % 3 != 0, "body\n").otherwise(""))
    return curation.agent_rows(docs.select(i.alias("path"), body.alias("content")), spark.range(1).select(F.lit("alpha").alias("skill")))


AGENTS = """WITH a AS (SELECT cast(doc_id AS varchar) AS path, CASE WHEN doc_id % 7 <> 0 THEN 'agent-' || doc_id END AS name,
  concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'Description spans lines without quotes' END, CASE WHEN doc_id % 7 = 0 THEN 'Missing field: name' END, CASE WHEN doc_id % 5 = 0 THEN 'Invalid model: gpt' END) AS errors,
  concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'No example' END, CASE WHEN doc_id % 3 = 0 THEN 'Empty body' END, 'Missing skill: beta') AS warnings FROM documents) """


@query(AGENTS + "SELECT path, name, errors = '' AS valid, errors, warnings FROM a")
def agents_validate(spark, sf):
    return agents(spark, sf).select("path", "name", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(AGENTS + """SELECT count(*) AS files, count(*) FILTER (errors = '') AS valid, cast(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END) AS bigint) AS errors,
 cast(sum(len(string_split(warnings, '; '))) AS bigint) AS warnings, cast(max(CASE WHEN errors = '' THEN 0 ELSE 1 END) AS integer) AS exit_code FROM a""")
def agents_totals(spark, sf):
    return curation.validation_totals(agents(spark, sf))


def recorded(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    head = F.when(F.col("doc_id") % 4 == 0, "\n## Audio Transcript\n").when(F.col("doc_id") % 4 == 1, "\n##  transcript\n").otherwise("")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("n"), head).alias("content"), "text")


@query("SELECT cast(doc_id AS varchar) AS path, doc_id % 4 < 2 AS has_transcript FROM documents")
def transcripts_there(spark, sf):
    return recorded(spark, sf).select("path", text.has_transcript(F.col("content")).alias("has_transcript"))


@query("""SELECT cast(doc_id AS varchar) AS path, cast(len(list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda x: x <> '')) AS integer) AS words,
 md5(concat('n', repeat(chr(10), 2), '---', repeat(chr(10), 2), '## Audio Transcript', repeat(chr(10), 2), '*Transcribed from: r.m4a*', repeat(chr(10), 2), text, repeat(chr(10), 2))) AS content_md5 FROM documents WHERE text IS NOT NULL AND doc_id % 4 > 1""")
def transcripts_added(spark, sf):
    rows = recorded(spark, sf)
    return curation.with_transcript(rows.select("path", "content"), rows.select("path", F.lit("r.m4a").alias("file"), "text")).select("path", "words", F.md5("new_content").alias("content_md5"))


TOPICS = {"topic/tools": ["tool", "work"], "topic/time": ["day", "year"], "topic/rare": ["zzzz"]}


@query("""SELECT cast(doc_id AS varchar) AS path, 'topic/tools' AS topic FROM documents WHERE contains(lower(text), 'tool') OR contains(lower(text), 'work')
 UNION ALL SELECT cast(doc_id AS varchar), 'topic/time' FROM documents WHERE contains(lower(text), 'day') OR contains(lower(text), 'year')""")
def keyword_topics(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return curation.keyword_tags(docs, TOPICS)


@query("""SELECT cast(doc_id AS varchar) AS path, md5(array_to_string(list_filter([
 '---', 'title: T', 'analysis:', '  quality_score: ' || (doc_id % 100) || '.0', '  action: keep', '  topics: [' || CASE doc_id % 3 WHEN 0 THEN 't, ' || lang WHEN 1 THEN lang ELSE '' END || ']',
 '  has_framework: ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, '  framework_description: ' || CASE WHEN doc_id % 2 = 0 THEN 'steps by ' || source ELSE 'null' END,
 CASE WHEN doc_id % 5 < 2 THEN '  key_questions:' END, CASE WHEN doc_id % 5 < 2 THEN '    - "Why \\"' || lang || '\\"?"' END, CASE WHEN doc_id % 5 = 0 THEN '    - "And then?"' END,
 CASE WHEN doc_id % 7 > 0 THEN '  reasoning: |' END, CASE WHEN doc_id % 7 > 0 THEN '    ' || replace(text, chr(10), chr(10) || '    ') END,
 '  analyzed_date: 2024-01-01', '  analyzed_model: m', '---', coalesce(text, '')], lambda x: x IS NOT NULL), chr(10))) AS content_md5 FROM documents""")
def analysis_blocks(spark, sf):
    """Notes with a block of an earlier analysis, which the new one replaces; texts serve as reasons."""
    docs = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    i, lang = F.col("doc_id"), F.col("lang")
    n = docs.select("path", F.concat(F.lit("---\ntitle: T\n"), F.when(i % 3 == 0, "analysis:\n  quality_score: 1\n  topics: [a]\n  reasoning: |\n    x\n\n    y\n").otherwise(""), F.lit("---\n"), F.coalesce("text", F.lit(""))).alias("content"))
    questions = F.when(i % 5 == 0, F.array(F.concat(F.lit('Why "'), lang, F.lit('"?')), F.lit("And then?"))).when(i % 5 == 1, F.array(F.concat(F.lit('Why "'), lang, F.lit('"?')))).when(i % 5 == 2, F.array().cast("array<string>"))
    r = docs.select(
        "path", (i % 100).cast("double").alias("score"), F.lit("keep").alias("action"), F.when(i % 3 == 0, F.array(F.lit("t"), lang)).when(i % 3 == 1, F.array(lang)).alias("topics"), (i % 2 == 0).alias("has_framework"),
        F.when(i % 2 == 0, F.concat(F.lit("steps by "), "source")).when(i % 4 == 1, "").alias("framework_description"), questions.alias("key_questions"), F.when(i % 7 > 0, F.col("text")).alias("reasoning"),
    )
    return curation.analysis_frontmatter(n, r, "2024-01-01", "m").select("path", F.md5("new_content").alias("content_md5"))


@query("""WITH p AS (SELECT l_orderkey AS pdf, CASE WHEN l_discount < 0.09 THEN l_quantity / 50.0::double END AS ssim, l_tax > 0.07 AND l_quantity < 10 AS failed FROM lineitem),
 q AS (SELECT pdf, CASE WHEN bool_or(failed) THEN 0 ELSE coalesce(avg(ssim), 1) END::double AS ssim FROM p GROUP BY pdf) SELECT pdf, round(ssim, 9) AS ssim, ssim >= 0.92 AS passed FROM q""")
def pdf_quality(spark, sf):
    """Pages that can't be compared have no score; a check that fails rejects its document. Pages are in the order of
    the table's rows, as the SQL adds them."""
    ssim = F.when(F.col("l_discount") < 0.09, F.col("l_quantity") / 50.0)
    scores = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pdf"), ssim.alias("ssim"), ((F.col("l_tax") > 0.07) & (F.col("l_quantity") < 10)).alias("failed"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return media.quality(scores, failed="failed", at=["file", "row"]).withColumn("ssim", F.round("ssim", 9))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 120 ELSE 150 END AS dpi, CASE WHEN doc_id % 2 = 0 THEN 60 ELSE 50 END AS quality, CASE WHEN doc_id % 2 = 0 THEN 1600 ELSE 1024 END AS longest, doc_id % 2 = 0 AS grayscale FROM documents")
def pdf_settings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *media.encoder_settings(F.col("doc_id") % 2 == 0))


@query("SELECT doc_id, ['jpg', 'jpeg', 'png', 'webp', 'bmp', 'tiff', 'tif', 'heic', 'heif', 'gif', 'svg'][doc_id % 11 + 1] AS ext, ['JPEG', 'JPEG', 'PNG', 'WEBP', 'JPEG', 'JPEG', 'JPEG', 'JPEG', 'JPEG', 'GIF', NULL][doc_id % 11 + 1] AS format FROM documents")
def image_formats(spark, sf):
    exts = F.lit([*media.FORMATS, "svg"])
    return table(spark, sf, "documents").select("doc_id", F.element_at(exts, (F.col("doc_id") % 11 + 1).cast("int")).alias("ext")).withColumn("format", media.target_format(F.col("ext")))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 50.0::double ELSE doc_id % 101 END AS quality_score, CASE WHEN doc_id % 7 = 0 THEN 'review' WHEN doc_id % 3 = 0 THEN 'archive' ELSE 'keep' END AS suggested_action,
 CASE WHEN doc_id % 7 = 0 THEN 'Error parsing LLM response' ELSE 'r' END AS reasoning, doc_id % 7 <> 0 AND doc_id % 3 = 0 AS has_framework, doc_id % 7 = 0 OR doc_id % 2 = 0 AS is_valuable,
 CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a,t' || doc_id % 5 END AS primary_topics, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN 'steps' END AS framework_description, '' AS key_questions FROM documents""")
def analysis_fields(spark, sf):
    """All fields of a model's replies; every seventh holds no JSON."""
    i = F.col("doc_id")
    more = F.when(i % 3 == 0, ', "suggested_action": "archive", "has_framework": true, "framework_description": "steps"').otherwise("")
    fields = F.concat(F.lit('{"quality_score": "'), (i % 101).cast("string"), F.lit('", "is_valuable": '), (i % 2 == 0).cast("string"), F.lit(', "primary_topics": ["a", "t'), (i % 5).cast("string"), F.lit('"], "reasoning": "r"'), more, F.lit("}"))
    replies = table(spark, sf, "documents").select("doc_id", F.when(i % 7 == 0, "none").otherwise(F.concat(F.lit("Sure:\n```json\n"), fields, F.lit("\n```"))).alias("reply"))
    return replies.select("doc_id", *providers.analysis_of()).withColumns({c: F.array_join(c, ",") for c in ("primary_topics", "key_questions")})


@query("SELECT event_id, props IS NOT NULL AS parsed, md5(props) AS json_md5 FROM events")
def json_repair(spark, sf):
    """Replies of a model around events' JSON, and the fields read from them as text, then cast."""
    raw = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))
    found = table(spark, sf, "events").select("event_id", arrow.json_object_span(raw).alias("json"))
    return found.select("event_id", F.col("json").isNotNull().alias("parsed"), F.md5("json").alias("json_md5"))


@query("SELECT doc_id, n_chars AS size FROM documents ORDER BY md5(cast(doc_id AS varchar)), doc_id LIMIT 100")
def sample_hash_order(spark, sf):
    return stats.keyed_sample(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size")), "doc_id", 100)


@query("WITH m AS (SELECT source, count(*) AS notes, string_agg('Doc ' || cast(doc_id AS varchar) || chr(10) || text, chr(10) || repeat('=', 80) || chr(10) ORDER BY doc_id) AS merged FROM documents GROUP BY source) SELECT source, notes, md5(merged) AS merged_md5 FROM m")
def merged_document(spark, sf):
    docs = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    return stats.merged_document(docs, "source", "title", "text", "doc_id").select("source", "notes", F.md5("merged").alias("merged_md5"))


@query("SELECT md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, doc_id FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


# --- media -------------------------------------------------------------------------------------------------------------


@query(f"WITH p AS (SELECT l_returnflag, l_quantity * 5 AS x, l_quantity * 5 + (l_linenumber - 4) * 3 AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM p GROUP BY 1) SELECT l_returnflag, round((2 * mx * my + {media.C1}) * (2 * c + {media.C2}) / ((mx * mx + my * my + {media.C1}) * (vx + vy + {media.C2})), 9) AS ssim FROM m")
def ssim_global(spark, sf):
    p = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") * 5).alias("x"), (F.col("l_quantity") * 5 + (F.col("l_linenumber") - 4) * 3).alias("y"))
    return media.ssim(p, ["l_returnflag"], "x", "y")


PAGES = "WITH pages_ AS (SELECT l_orderkey AS pdf, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS page, count(*) OVER (PARTITION BY l_orderkey) AS n_pages, cast(l_quantity * 20 AS bigint) AS text_len, l_linenumber % 3 AS n_images FROM lineitem) "


def pdf_pages(spark, sf) -> DataFrame:
    from pyspark.sql.window import Window as W

    w = W.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pdf"), (F.row_number().over(w.orderBy("l_linenumber", "l_partkey")) - 1).cast("long").alias("page"), F.count("*").over(w).alias("n_pages"), (F.col("l_quantity") * 20).cast("long").alias("text_len"), (F.col("l_linenumber") % 3).alias("n_images"))


@query(PAGES + ", a AS (SELECT pdf, avg(text_len) AS t, avg(n_images) AS i FROM pages_ WHERE n_pages <= 20 OR page < 10 OR page >= n_pages - 10 GROUP BY pdf) SELECT pdf, round(t, 6) AS avg_text, round(i, 6) AS avg_images, round(i / (t + 1), 9) AS ratio, (t < 200 AND i >= 0.5) OR (i >= 0.8 AND t < 300) OR (i > 0 AND i / (t + 1) > 0.005) AS is_scanned FROM a")
def scanned_classifier(spark, sf):
    return media.scanned(pdf_pages(spark, sf))


@query(PAGES + "SELECT pdf, page, n_pages FROM pages_ WHERE page = 0 OR page = n_pages - 1 OR (n_pages > 2 AND page = n_pages // 2)")
def page_sample(spark, sf):
    return media.sampled_pages(pdf_pages(spark, sf)).select("pdf", "page", "n_pages")


@query("WITH i AS (SELECT doc_id, cast(n_chars % 4000 + 1 AS integer) AS w, cast(doc_id % 3000 + 1 AS integer) AS h FROM documents) SELECT doc_id, cast(CASE WHEN w > h AND w > 1440 THEN 1440 WHEN w <= h AND h > 1440 THEN trunc(w * (1440.0::double / h)) ELSE w END AS integer) AS width, cast(CASE WHEN w > h AND w > 1440 THEN trunc(h * (1440.0::double / w)) WHEN w <= h AND h > 1440 THEN 1440 ELSE h END AS integer) AS height FROM i")
def resize_dims(spark, sf):
    i = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 4000 + 1).cast("int").alias("w"), (F.col("doc_id") % 3000 + 1).cast("int").alias("h"))
    w, h = media.resized(F.col("w"), F.col("h"))
    return i.select("doc_id", w.alias("width"), h.alias("height"))


@query("WITH r AS (SELECT n_chars AS original, n_chars * (doc_id % 13) // 10 AS compressed FROM documents) SELECT count(*) AS files, count(*) FILTER (compressed < original) AS compressed_files, count(*) FILTER (compressed >= original) AS kept_files, cast(coalesce(sum(original - compressed) FILTER (compressed < original), 0) AS bigint) AS saved, round(100.0::double * sum(original - compressed) FILTER (compressed < original) / sum(original), 6) AS saved_pct FROM r")
def compression_savings(spark, sf):
    return media.savings(table(spark, sf, "documents").select(F.col("n_chars").alias("original"), F.expr("n_chars * (doc_id % 13) div 10").alias("compressed")))


@query("SELECT l_returnflag, round(sum(abs(r - g) + abs(g - b) + abs(r - b)) / (3 * count(*)), 9) AS variance, sum(abs(r - g) + abs(g - b) + abs(r - b)) / (3 * count(*)) < 30 AS is_gray FROM (SELECT l_returnflag, l_quantity AS r, l_linenumber * 10 AS g, l_discount * 1000 AS b FROM lineitem) GROUP BY 1")
def gray_detection(spark, sf):
    """Every pixel counts; media.is_gray() samples only where it is given what tells pixels apart."""
    p = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("r"), (F.col("l_linenumber") * 10).alias("g"), (F.col("l_discount") * 1000).alias("b"))
    return media.is_gray(p, ["l_returnflag"])


@query("""WITH f AS (SELECT doc_id, n_chars AS size, n_chars * (doc_id % 13) // 10 AS compressed, CASE WHEN doc_id % 17 <> 0 THEN (doc_id % 11) / 10.0::double END AS ssim, doc_id % 19 <> 0 AS tried FROM documents),
 l AS (SELECT *, tried AND compressed < size AS smaller, coalesce(ssim, 0) >= 0.92 AS good FROM f WHERE size > 1024) SELECT (SELECT count(*) FROM f) AS pdfs_scanned, count(*) AS large_pdfs_found, count(*) FILTER (smaller AND good) AS pdfs_compressed,
 count(*) FILTER (smaller AND NOT good) AS quality_rejected, count(*) FILTER (NOT (smaller AND good)) AS compression_failed, round(coalesce(sum(size - compressed) FILTER (smaller AND good), 0) / 1048576.0::double, 9) AS space_saved_mb FROM l""")
def compression_totals(spark, sf):
    """Counters of a run over documents as PDFs: some have no result, some no quality."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    results = docs.where("doc_id % 19 <> 0").select(i.alias("pdf"), F.expr("n_chars * (doc_id % 13) div 10").alias("compressed"), F.when(i % 17 != 0, (i % 11) / 10.0).alias("ssim"))
    return media.compression_totals(docs.select(i.alias("pdf"), F.col("n_chars").alias("size")), results, 1.0)


@query("SELECT l_partkey, CASE WHEN count(*) > 100 THEN bool_or(l_quantity < 5 AND l_orderkey % 100 = 0) ELSE bool_or(l_quantity < 5) END AS transparent FROM lineitem GROUP BY 1")
def transparency(spark, sf):
    px = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_quantity") < 5, 0).otherwise(255).alias("alpha"))
    return media.transparent(px, ["l_partkey"], "l_orderkey", "alpha")


@query("SELECT count(*) AS files, round(sum(n_chars) / 1048576.0::double, 9) AS megabytes, round(2 * sum(n_chars) / 1048576.0::double, 9) AS eta_seconds FROM documents")
def transcription_totals(spark, sf):
    return media.transcription_totals(table(spark, sf, "documents").select(F.col("n_chars").alias("size")))


# --- extensions --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return increments.tumbling_counts(table(spark, sf, "events"))


@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS first FROM events WHERE ts IS NOT NULL),
 s AS (SELECT *, sum(first::integer) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end, count(*) AS events FROM s GROUP BY user_id, s""")
def events_sessions(spark, sf):
    return increments.sessions(table(spark, sf, "events"))


@query("WITH " + REPORT_SQL + """, d AS (SELECT source || '/' || cast(doc_id AS varchar) || '.md' AS path, doc_id, n_chars, lang FROM documents)
 SELECT d.path, cast(n_chars % 101 AS double) AS score, 'revised-' || lang AS action, cast(2 AS bigint) AS revision, r.reasoning FROM d LEFT JOIN report r USING (path)""")
def report_stream(spark, sf):
    """The report under a stream of analyses: two revisions of every document's, dealt over micro-batches so that the
    older one often comes later. Documents without a row get one."""
    rows = report(spark, sf).select("path", "score", "action", F.lit(0).cast("long").alias("revision"), "reasoning")
    docs = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    news = docs.select(path.alias("path"), "doc_id", "n_chars", "lang", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("revision"))
    score, action = F.when(F.col("revision") == 2, F.col("n_chars") % 101).otherwise(-1).cast("double"), F.concat(F.when(F.col("revision") == 2, "revised-").otherwise("seen-"), "lang")
    feed, kept, log = (scratch(spark, n) for n in ("feed", "report", "log"))
    turn = (F.col("doc_id") + F.col("revision")) % 3
    news.select("path", score.alias("score"), action.alias("action"), "revision", turn.alias("turn")).repartition(3, "turn").drop("turn").write.parquet(feed)
    upserts.start(rows, kept)
    stream = spark.readStream.schema("path string, score double, action string, revision long").option("maxFilesPerTrigger", 1).parquet(feed)
    stream = stream.writeStream.foreachBatch(upserts.upsert_into(kept, "path", "revision")).option("checkpointLocation", log)
    stream.trigger(availableNow=True).start().awaitTermination()
    return upserts.current(spark, kept)
