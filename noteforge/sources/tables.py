"""Adapters: a vault of notes and attachments, transcripts and reports, derived from the test tables.

The synthetic documents hold no markup, so the vault adds it by fixed rules of doc_id. Each adapter has a SQL twin (a
common table expression for DuckDB) that the queries' SQL starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, name, folder, content: every document as a Markdown note; four notes share a base name."""
    docs = table(spark, sf_dir, "documents")
    base = F.floor(F.col("doc_id") / 4).cast("long").cast("string")
    k, i, lang = F.col("doc_id") % 4, F.col("doc_id").cast("string"), F.col("lang")
    name = F.concat(F.lit("note "), base, F.when(k == 0, "").otherwise(F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))), F.lit(".md"))
    third = F.col("doc_id") % 3
    tags = (
        F.when(third == 0, F.concat(F.lit("tags: ['risk-management', 'innovation', 'ppp', 'lang/"), lang, F.lit("']\n")))
        .when(third == 1, F.concat(F.lit("tags:\n  - topic/risk\n  - lang/"), lang, F.lit("\n")))
        .otherwise(F.lit("tags: [topic/infrastructure, typsa]\n"))
    )
    front = F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.concat(F.lit('---\ntitle: "Doc '), i, F.lit('"\n'), tags, F.lit("---\n")))
    embed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("![[file "), i, F.lit(".png|pic]]\n"))).otherwise("")
    link = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("![alt](../Attachments/img/file "), (F.col("doc_id") + 3).cast("string"), F.lit(".png?w=1)\n"))).otherwise("")
    content = F.concat(front, F.lit("# Note "), base, F.lit("\n"), F.col("text"), F.lit("\n"), embed, link, F.lit("#general and #topic/risk plus `#code` and #off-topic\n"))
    return docs.select("doc_id", F.concat("source", F.lit("/"), name).alias("path"), name.alias("name"), F.col("source").alias("folder"), content.alias("content"))


NOTES_SQL = r"""notes AS (
  SELECT doc_id, source || '/' || name AS path, name, source AS folder, content FROM (
    SELECT doc_id, source,
      'note ' || cast(doc_id // 4 AS varchar) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' (' || cast(doc_id % 4 AS varchar) || ')' END || '.md' AS name,
      CASE WHEN doc_id % 10 = 9 THEN '' ELSE '---' || chr(10) || 'title: "Doc ' || cast(doc_id AS varchar) || '"' || chr(10) ||
        CASE doc_id % 3 WHEN 0 THEN 'tags: [''risk-management'', ''innovation'', ''ppp'', ''lang/' || lang || ''']' || chr(10)
          WHEN 1 THEN 'tags:' || chr(10) || '  - topic/risk' || chr(10) || '  - lang/' || lang || chr(10)
          ELSE 'tags: [topic/infrastructure, typsa]' || chr(10) END || '---' || chr(10) END
      || '# Note ' || cast(doc_id // 4 AS varchar) || chr(10) || text || chr(10)
      || CASE WHEN doc_id % 2 = 0 THEN '![[file ' || cast(doc_id AS varchar) || '.png|pic]]' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 5 = 0 THEN '![alt](../Attachments/img/file ' || cast(doc_id + 3 AS varchar) || '.png?w=1)' || chr(10) ELSE '' END
      || '#general and #topic/risk plus `#code` and #off-topic' || chr(10) AS content
    FROM documents))"""


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path, name, size, hash: an attachment for every third document; equal texts are equal files."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    name = F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".png"))
    return docs.select(F.concat(F.lit("img/"), name).alias("rel_path"), name.alias("name"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"))


ATTACHMENTS_SQL = """attachments AS (
  SELECT 'img/file ' || cast(doc_id AS varchar) || '.png' AS rel_path, 'file ' || cast(doc_id AS varchar) || '.png' AS name, n_chars AS size, md5(text) AS hash
  FROM documents WHERE doc_id % 3 = 0)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, size: file names as they occur in vaults, by fixed rules of doc_id."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    digest = F.md5(i)
    uuid = F.concat(*[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(digest, a, n), F.lit("-"))][:-1])
    kind = F.col("doc_id") % 9
    file = (
        F.when(kind == 0, F.concat(F.lit("Screenshot 2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" at 9.15."), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit(".png")))
        .when(kind == 1, F.concat(F.lit("IMG_"), i, F.lit(".JPG")))
        .when(kind == 2, F.concat(uuid, F.lit(".jpg")))
        .when(kind == 3, F.concat(digest, F.lit(".pdf")))
        .when(kind == 4, F.concat(F.lit(".conf"), i))
        .when(kind == 5, F.concat(F.lit("a"), i, F.lit(".")))
        .when(kind == 6, F.lit("ab.png"))
        .when(kind == 7, F.concat(F.lit("Quarterly report of the "), F.col("source"), F.lit(" 12-31-2023 final version.docx")))
        .otherwise(F.concat(F.lit("photo "), F.col("lang"), F.lit(" 20240131.m4a")))
    )
    return docs.select("doc_id", file.alias("file"), F.col("n_chars").alias("size"))


NAMES_SQL = """names AS (
  SELECT doc_id, n_chars AS size, CASE doc_id % 9
    WHEN 0 THEN 'Screenshot 2024-01-' || lpad(cast(doc_id % 28 + 1 AS varchar), 2, '0') || ' at 9.15.' || lpad(cast(doc_id % 60 AS varchar), 2, '0') || '.png'
    WHEN 1 THEN 'IMG_' || cast(doc_id AS varchar) || '.JPG'
    WHEN 2 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '.jpg'
    WHEN 3 THEN h || '.pdf'
    WHEN 4 THEN '.conf' || cast(doc_id AS varchar)
    WHEN 5 THEN 'a' || cast(doc_id AS varchar) || '.'
    WHEN 6 THEN 'ab.png'
    WHEN 7 THEN 'Quarterly report of the ' || source || ' 12-31-2023 final version.docx'
    ELSE 'photo ' || lang || ' 20240131.m4a' END AS file
  FROM (SELECT *, md5(cast(doc_id AS varchar)) AS h FROM documents))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rel_path, size: paths in hidden, backup, tool and ordinary folders."""
    docs = table(spark, sf_dir, "documents")
    folders = [".trash/", ".obsidian/", ".claude/agents/", "Attachments/", "Attachments/backup/", "_drafts/", "INBOX/Dune - Chapters/", "logs/", ".git/", ""]
    folder = F.element_at(F.lit(folders), (F.col("doc_id") % 10 + 1).cast("int"))
    ext = F.element_at(F.lit(["md", "PNG", "pdf", "jpeg", "m4a", "md", "PDF"]), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 13 == 0, "README.md").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return docs.select("doc_id", F.concat(folder, name).alias("rel_path"), F.col("n_chars").alias("size"))


PATHS_SQL = """paths AS (
  SELECT doc_id, n_chars AS size,
    ['.trash/', '.obsidian/', '.claude/agents/', 'Attachments/', 'Attachments/backup/', '_drafts/', 'INBOX/Dune - Chapters/', 'logs/', '.git/', ''][doc_id % 10 + 1]
    || CASE WHEN doc_id % 13 = 0 THEN 'README.md' ELSE 'f' || cast(doc_id AS varchar) || '.' || ['md', 'PNG', 'pdf', 'jpeg', 'm4a', 'md', 'PDF'][doc_id % 7 + 1] END AS rel_path
  FROM documents)"""


def backup(notes: DataFrame) -> DataFrame:
    """path, hash of a backup of notes: some are missing, some differ, some exist there alone."""
    kept = notes.where("doc_id % 11 <> 0").select("path", F.md5(F.concat("content", F.when(F.col("doc_id") % 7 == 0, "edited").otherwise(""))).alias("hash"))
    old = notes.where("doc_id % 13 = 0").select(F.concat(F.lit("old/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.md5("content").alias("hash"))
    return kept.unionByName(old)


BACKUP_SQL = """backup AS (
  SELECT path, md5(content || CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE '' END) AS hash FROM notes WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'old/' || cast(doc_id AS varchar) || '.md', md5(content) FROM notes WHERE doc_id % 13 = 0)"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, score, action, reasoning, has_framework, input_tokens, output_tokens, seconds: an analysis report."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    action = F.when(F.col("quality") == 0, "archive").when(F.col("toxic") == 1, "review").otherwise("keep")
    return docs.join(labels, "doc_id").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        (F.col("doc_id") % 101).cast("double").alias("score"),
        action.alias("action"),
        F.when(F.col("doc_id") % 17 == 0, "Error parsing LLM response").when(F.col("doc_id") % 19 != 0, "ok").alias("reasoning"),
        (F.col("doc_id") % 5 == 0).alias("has_framework"),
        (F.length("text") / 4).cast("long").alias("input_tokens"),
        (F.col("doc_id") % 300).alias("output_tokens"),
        ((F.col("doc_id") % 40) / 8).alias("seconds"),
    )


REPORT_SQL = """report AS (
  SELECT source || '/' || cast(doc_id AS varchar) || '.md' AS path, cast(doc_id % 101 AS double) AS score,
    CASE WHEN quality = 0 THEN 'archive' WHEN toxic = 1 THEN 'review' ELSE 'keep' END AS action,
    CASE WHEN doc_id % 17 = 0 THEN 'Error parsing LLM response' WHEN doc_id % 19 <> 0 THEN 'ok' END AS reasoning,
    doc_id % 5 = 0 AS has_framework, length(text) // 4 AS input_tokens, doc_id % 300 AS output_tokens, (doc_id % 40) / 8.0::double AS seconds
  FROM documents JOIN labels USING (doc_id))"""
