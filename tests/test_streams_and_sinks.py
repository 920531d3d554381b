"""The vault stream, report upserts, the plan sink and the language detector."""

import fnmatch
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from noteforge.operators import curation, language, references
from noteforge.plans import plan, sink
from noteforge.sources.vault import VaultSource
from noteforge.streaming import report_upsert

# --- the vault as a stream ---------------------------------------------------------------------------------------------


def put(root, rel, text, age=5.0):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    then = time.time() - age
    os.utime(path, (then, then))


def drain(spark, root, out, log, **options):
    """Runs the stream to its end; what each batch brought."""
    spark.dataSource.register(VaultSource)
    rows = spark.readStream.format("vault").options(relation="contents", **options).load(str(root))
    rows = rows.select("rel_path", F.decode("content", "utf-8").alias("text"))
    query = rows.writeStream.format("parquet").option("checkpointLocation", str(log)).trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    return sorted((r["rel_path"], r["text"]) for r in spark.read.parquet(str(out)).collect())


def test_vault_stream_stops_and_resumes(spark, tmp_path):
    """New and changed files once each over restarts; gone, hidden and unsettled files stay out."""
    root, out, log = tmp_path / "vault", tmp_path / "out", tmp_path / "log"
    put(root, "b.md", "b1", 50)
    put(root, "a/x #1.md", "x1", 50)  # same time as b.md: paths break the tie
    put(root, ".trash/t.md", "t")
    put(root, "_n.md", "")
    first = [("_n.md", ""), ("a/x #1.md", "x1"), ("b.md", "b1")]
    assert drain(spark, root, out, log) == first
    assert drain(spark, root, out, log) == first  # nothing new
    put(root, "b.md", "b2", 4)
    put(root, "c.md", "c1", 3)
    put(root, "soon.md", "s1", -3600)  # its time has not settled
    os.remove(root / "_n.md")
    second = sorted([*first, ("b.md", "b2"), ("c.md", "c1")])
    assert drain(spark, root, out, log) == second
    os.remove(root / "c.md")  # the newest file goes: what is left was read
    assert drain(spark, root, out, log) == second
    put(root, "soon.md", "s2", 2)
    assert drain(spark, root, out, log) == sorted([*second, ("soon.md", "s2")])


def test_vault_stream_runs_a_failed_batch_again(spark, tmp_path):
    """A batch that failed is planned from the same offsets: its files come once, a file changed since comes later."""
    root, log, seen, fail = tmp_path / "vault", str(tmp_path / "log"), {}, [True]
    put(root, "a.md", "a1", 20)
    put(root, "b.md", "b1", 20)
    spark.dataSource.register(VaultSource)

    def batch(rows, i):
        if fail[0]:
            raise RuntimeError("lost")
        seen.setdefault(i, sorted((r["rel_path"], bytes(r["content"]).decode()) for r in rows.collect()))

    def go():
        rows = spark.readStream.format("vault").option("relation", "contents").load(str(root))
        query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    put(root, "b.md", "b2", 5)
    fail[0] = False
    go()
    assert seen == {0: [("a.md", "a1")]}
    go()
    assert seen == {0: [("a.md", "a1")], 1: [("b.md", "b2")]}


def test_vault_stream_by_change_sees_old_files_moved_in(spark, tmp_path):
    root, out, log = tmp_path / "vault", tmp_path / "out", tmp_path / "log"
    put(root, "a.md", "a", 5)
    time.sleep(0.2)
    assert drain(spark, root, out, log, clock="change", settle_ms="100") == [("a.md", "a")]
    put(root, "old.md", "o", 900)
    time.sleep(0.2)
    assert drain(spark, root, out, log, clock="change", settle_ms="100") == [("a.md", "a"), ("old.md", "o")]


def test_vault_subfolder(spark, tmp_path):
    root = tmp_path / "vault"
    for rel in ("a.md", "in/b.md", "in/.trash/c.md", "in/d/e.md", "in/d/f.png"):
        put(root, rel, "x")
    spark.dataSource.register(VaultSource)
    rows = spark.read.format("vault").options(subfolder="in", policy="strict", suffix=".md").load(str(root))
    assert sorted(r["rel_path"] for r in rows.collect()) == ["in/b.md", "in/d/e.md"]
    assert spark.read.format("vault").options(subfolder="no", policy="strict").load(str(root)).count() == 0


# --- the report under a stream -----------------------------------------------------------------------------------------

ROW = "path string, score double, revision long"


def report_rows(spark, path):
    return sorted(tuple(r) for r in report_upsert.current(spark, path).collect())


def test_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "report")
    report_upsert.start(spark.createDataFrame([("a", "old", 1.0, 0), ("b", "old", 1.0, 5), ("n", None, None, None)], "path string, note string, score double, revision long"), path)
    put_in = report_upsert.upsert_into(path, "path", "revision", keep=3)
    batch = spark.createDataFrame([("a", 2.0, 1), ("a", 3.0, 2), ("a", 2.5, 2), ("b", 9.0, 4), ("c", 7.0, 1), ("n", 4.0, 1), (None, 1.0, 1)], ROW)
    put_in(batch, 0)
    want = [("a", "old", 3.0, 2), ("b", "old", 1.0, 5), ("c", None, 7.0, 1), ("n", None, 4.0, 1)]
    assert report_rows(spark, path) == want and report_upsert.versions(spark, path) == [0, 1]
    put_in(batch, 0)  # a replay
    put_in(spark.createDataFrame([("a", 99.0, 99)], ROW), 0)  # whatever it brings
    assert report_rows(spark, path) == want and report_upsert.versions(spark, path) == [0, 1]
    os.remove(f"{report_upsert.version_path(path, 1)}/_SUCCESS")  # cut off while it was written
    put_in(batch, 0)
    assert report_rows(spark, path) == want
    put_in(spark.createDataFrame([], ROW), 1)
    assert report_rows(spark, path) == want
    put_in(spark.createDataFrame([("b", 6.0, 6)], ROW), 2)
    assert report_rows(spark, path)[1] == ("b", "old", 6.0, 6) and report_upsert.versions(spark, path) == [1, 2, 3]
    report_upsert.start(batch, path)  # a report that is there stays
    assert report_rows(spark, path)[1] == ("b", "old", 6.0, 6)


def test_vault_to_report(spark, tmp_path):
    """Notes that change while they are watched, analysed into a report; the log of commits is lost in between, so the
    last batch runs twice."""
    root, path, log = tmp_path / "vault", str(tmp_path / "report"), tmp_path / "log"
    spark.dataSource.register(VaultSource)
    report_upsert.start(spark.createDataFrame([], ROW), path)

    def go():
        rows = spark.readStream.format("vault").option("relation", "contents").load(str(root))
        rows = rows.select(F.col("rel_path").alias("path"), F.length("content").cast("double").alias("score"), F.lit(1).cast("long").alias("revision"))
        rows.writeStream.foreachBatch(report_upsert.upsert_into(path, "path", "revision")).option("checkpointLocation", str(log)).trigger(availableNow=True).start().awaitTermination()

    put(root, "a.md", "12345", 60)
    go()
    put(root, "a.md", "123", 40)
    put(root, "b.md", "1", 40)
    go()
    want = [("a.md", 3.0, 1), ("b.md", 1.0, 1)]
    assert report_rows(spark, path) == want
    for name in ("1", ".1.crc"):
        os.remove(log / "commits" / name)
    go()
    assert report_rows(spark, path) == want and report_upsert.versions(spark, path)[-1] == 2


def test_first_of_content_forgets_with_the_watermark(spark, tmp_path):
    from noteforge.streaming import increments

    for i, part in enumerate(([("h1", "00:00"), ("h2", "00:10"), ("h1", "00:05")], [("h1", "00:30"), ("h3", "05:00")], [("h1", "05:10"), ("h3", "05:20")])):
        df = spark.createDataFrame(part, "hash string, at string").select("hash", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("hash string, ts timestamp").parquet(str(tmp_path / "in"))
        increments.first_of_content(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r["hash"], str(r["ts"])[11:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[0] != "h1"] == [("h2", "00:10"), ("h3", "05:00")]
    assert [g[1] for g in got if g[0] == "h1"] in (["00:00", "05:10"], ["00:05", "05:10"])


# --- plans by executors ------------------------------------------------------------------------------------------------


def plan_rows(spark, rows):
    return spark.createDataFrame([{c: None for c in plan.COLUMNS} | r for r in rows], ", ".join(f"{c} string" for c in plan.COLUMNS)).repartition(3)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if sink.STAGING not in d}


ROWS = [
    {"action": "MOVE", "src_path": "a.md", "dest_path": ".trash/x/a.md"},
    {"action": "MOVE", "src_path": "b.md", "dest_path": "t/one.md"},
    {"action": "MOVE", "src_path": "c.md", "dest_path": "t/one.md"},
    {"action": "COPY", "src_path": "d.md", "dest_path": "copies/d.md"},
    {"action": "COPY", "src_path": "d.md", "dest_path": "e.md"},
    {"action": "REWRITE", "src_path": "e.md", "new_content": "new\r\n"},
    {"action": "DELETE", "src_path": "f.md"},
    {"action": "DELETE", "src_path": "no.md"},
    {"action": "DELETE", "src_path": "dir"},
    {"action": "DELETE", "src_path": "../out"},
    {"action": "COPY", "src_path": "d.md", "dest_path": "../out2"},
    {"action": "DELETE", "src_path": ".noteforge/x"},
    {"action": "KEEP", "src_path": "d.md"},
]


def vault(tmp_path):
    root = tmp_path / "vault"
    for n in "abcdefg":
        put(root, f"{n}.md", n)
    put(root, "dir/h.md", "h")
    (tmp_path / "out").write_text("out")
    return root


def test_plan_is_carried_out_by_tasks(spark, tmp_path):
    root = vault(tmp_path)
    with pytest.raises(Exception, match="confirm"):
        sink.run(plan_rows(spark, ROWS), str(root))
    assert len(tree(root)) == 8 and not (root / sink.STAGING).exists()
    got = sorted((r["action"], r["src_path"], r["dest_path"] or "", r["status"]) for r in sink.run(plan_rows(spark, ROWS), str(root), confirm=True).collect())
    moved = [r[3] for r in got if r[2] == "t/one.md"]
    assert sorted(moved) == ["DONE", "EXISTS"]
    assert {(r[0], r[1], r[2]): r[3] for r in got if r[2] != "t/one.md"} == {
        ("MOVE", "a.md", ".trash/x/a.md"): "DONE", ("COPY", "d.md", "copies/d.md"): "DONE", ("COPY", "d.md", "e.md"): "EXISTS", ("REWRITE", "e.md", ""): "DONE", ("DELETE", "f.md", ""): "DONE", ("DELETE", "no.md", ""): "MISSING",
        ("DELETE", "dir", ""): "SKIP_DIR", ("DELETE", "../out", ""): "OUTSIDE", ("COPY", "d.md", "../out2"): "OUTSIDE", ("DELETE", ".noteforge/x", ""): "OUTSIDE", ("KEEP", "d.md", ""): "UNKNOWN",
    }
    left = "c" if moved and tree(root)["t/one.md"] == "b" else "b"
    assert tree(root) == {".trash/x/a.md": "a", "t/one.md": "b" if left == "c" else "c", f"{left}.md": left, "d.md": "d", "copies/d.md": "d", "e.md": "new\n", "g.md": "g", "dir/h.md": "h"}
    assert (root / "e.md").read_bytes() == b"new\r\n"


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    """One task fails after others are done: no file of the vault differs, no staged file is left."""
    root = vault(tmp_path)
    rows = plan_rows(spark, ROWS).unionByName(plan_rows(spark, [{"action": "REWRITE", "src_path": "g.md"}]).withColumn("new_content", F.raise_error(F.lit("lost")).cast("string")))
    before = tree(root)
    with pytest.raises(Exception, match="lost"):
        sink.run(rows, str(root), confirm=True)
    assert tree(root) == before and not (root / sink.STAGING).exists()


def test_runs_cut_off_are_finished_or_removed(spark, tmp_path, monkeypatch):
    """A crash before the commit undoes, a crash behind it rolls forward, also when half of the steps were done."""
    root = vault(tmp_path)
    before = tree(root)
    rows = plan_rows(spark, [r for r in ROWS if r.get("dest_path") != "t/one.md"])
    with monkeypatch.context() as m:
        m.setattr(sink, "publish", lambda *a: None)
        sink.run(rows, str(root), confirm=True)
    (run,) = os.listdir(root / sink.STAGING)
    assert tree(root) == before
    done = []
    for part in (root / sink.STAGING / run).glob("part-*"):
        for line in (part / "journal.json").read_text().splitlines():
            entry = sink.json.loads(line)
            if entry["status"] == "TODO" and len(done) < 3:
                done.append(sink.published(root, entry))
                assert sink.published(root, entry) == done[-1] == "DONE"
    (root / sink.STAGING / "cut" / "part-0-1").mkdir(parents=True)
    assert sink.recover(spark, str(root)) == {run: "PUBLISHED", "cut": "REMOVED"}
    assert tree(root) == {".trash/x/a.md": "a", "b.md": "b", "c.md": "c", "d.md": "d", "copies/d.md": "d", "e.md": "new\n", "g.md": "g", "dir/h.md": "h"}
    assert sink.recover(spark, str(root)) == {}
    statuses = [r["status"] for r in sink.publish(spark, str(root), run).collect()]
    assert statuses.count("DONE") == 4 and len(statuses) == 11


def test_empty_plan(spark, tmp_path):
    root = vault(tmp_path)
    assert sink.run(plan_rows(spark, ROWS).where("false"), str(root), confirm=True).count() == 0 and len(tree(root)) == 8


# --- languages ---------------------------------------------------------------------------------------------------------


def test_detector_by_hand(spark):
    rows = spark.createDataFrame([("aaa b", "x"), ("abab", "y"), (None, "x"), ("q", None)], "text string, lang string")
    m = language.fit(rows)
    assert m.names == ["x", "y"] and {r["gram"] for r in m.grams.collect()} == {" aa", "aaa", "aa ", "a b", " b ", " ab", "aba", "bab", "ab "}
    asked = spark.createDataFrame([(1, "AAA!"), (2, "abab abab"), (3, ""), (4, None), (5, "12 34"), (6, "ü 🙂 ")], "id long, text string")
    got = {r["id"]: (r["best"], r["prob"]) for r in m.detect(asked, "id", "text").collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and got[3] == got[4] == got[5] == (None, 0.0)
    seen, size = {"x": {" aa": 1, "aaa": 1, "aa ": 1, "a b": 1, " b ": 1}, "y": {" ab": 1, "aba": 1, "bab": 1, "ab ": 1}}, {"x": 5 + 9, "y": 4 + 9}
    like = {k: 0.5 for k in seen}
    for g in (" aa", "aaa", "aa "):
        like = {k: v * (seen[k].get(g, 0) + 1) / size[k] for k, v in like.items()}
    assert abs(got[1][1] - like["x"] / sum(like.values())) < 1e-5
    only = {r["id"]: r["best"] for r in m.detect(asked, "id", "text", ["y"]).collect()}
    assert only[2] == "y" and only[1] == ("y" if like["y"] / sum(like.values()) >= 0.1 else None)
    assert language.fit(rows.where("false")).detect(asked, "id", "text").where("best is not null").count() == 0


def test_detector_joins_by_shuffle_alike(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language.fit(docs.where("doc_id % 2 = 0"))
    ask = docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text")
    a = sorted(map(str, m.detect(ask, "doc_id", "text").select("doc_id", "best", "prob").collect()))
    monkeypatch.setattr(language, "MOST_BROADCAST", -1)
    assert a == sorted(map(str, m.detect(ask, "doc_id", "text").select("doc_id", "best", "prob").collect()))
    assert m.detect(ask, "doc_id", "text").where("best = lang").count() > 0.95 * ask.count()


def test_third_language_counts_as_spanish(spark):
    """As in the tool that this matches; a detector that offers more languages than two."""
    body = "palabras y más palabras " * 5
    notes = spark.createDataFrame([("a", f"---\ntags: [x]\n---\n{body}"), ("b", f"---\ntags: [x]\n---\n{body}")], "path string, content string")
    row = curation.language_funnel(notes, detector=lambda rows: rows.withColumns({"best": F.when(F.col("path") == "a", "fr").otherwise("en"), "prob": F.lit(0.9)})).first()
    assert (row["detected_en"], row["detected_es"], row["added"]) == (1, 1, 2)


# --- blocks in notes ---------------------------------------------------------------------------------------------------


def test_analysis_block_is_the_tools(spark):
    notes = spark.createDataFrame([("a", "---\ntitle: T\nanalysis:\n  quality_score: 1\n\n  reasoning: |\n    x\ntags: [q]\n---\nbody\n"), ("b", "---\nx: 1\n---\nB"), ("c", "no front")], "path string, content string")
    r = [("a", 85.0, "keep", ["ppp", "risk"], True, "five steps", ['Why "now"?', "How?"], "first\nsecond"), ("b", 5.0, "archive", None, False, None, [], ""), ("c", 1.0, "keep", None, False, "", None, None)]
    report = spark.createDataFrame(r, "path string, score double, action string, topics array<string>, has_framework boolean, framework_description string, key_questions array<string>, reasoning string")
    got = {x["path"]: x["new_content"] for x in curation.analysis_frontmatter(notes, report, "2024-05-06", "m1").collect()}
    assert got == {
        "a": '---\ntitle: T\ntags: [q]\nanalysis:\n  quality_score: 85.0\n  action: keep\n  topics: [ppp, risk]\n  has_framework: true\n  framework_description: five steps\n  key_questions:\n    - "Why \\"now\\"?"\n    - "How?"\n'
        "  reasoning: |\n    first\n    second\n  analyzed_date: 2024-05-06\n  analyzed_model: m1\n---\nbody\n",
        "b": "---\nx: 1\nanalysis:\n  quality_score: 5.0\n  action: archive\n  topics: []\n  has_framework: false\n  framework_description: null\n  analyzed_date: 2024-05-06\n  analyzed_model: m1\n---\nB",
    }


def test_transcript_section_is_the_tools(spark):
    notes = spark.createDataFrame([("a", "note"), ("b", "x\n## Transcript\n"), ("c", "n")], "path string, content string")
    texts = spark.createDataFrame([("a", "r.m4a", "said  this"), ("b", "r.m4a", "t"), ("c", "r.m4a", None)], "path string, file string, text string")
    got = [tuple(r) for r in curation.with_transcript(notes, texts).collect()]
    assert got == [("a", 2, "note\n\n---\n\n## Audio Transcript\n\n*Transcribed from: r.m4a*\n\nsaid  this\n\n")]


# --- many patterns, name patterns, renames -----------------------------------------------------------------------------


def test_many_patterns_in_slices(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc[](/. ") for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "🙂[[ü.png]]x"]
    patterns = ["".join(rng.choice("abc[](/.") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["[[ü.png]]", "ü", "", None, "a", "a"]
    df, asked = spark.createDataFrame([(t,) for t in texts], "body string").repartition(4), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = sorted({p for p in patterns if p and any(p in (t or "") for t in texts)})
    for size in (10_000, 100):
        assert sorted(r[0] for r in references.found_patterns(df, "body", asked, size).collect()) == want
    assert references.found_patterns(df, "body", asked.where("false")).count() == 0


def test_name_patterns(spark):
    rng = random.Random(4)
    names = list({"".join(rng.choice("ab.-_[]!^Z9 é") for _ in range(rng.randint(1, 7))) for _ in range(500)}) + ["IMG_1.png", "IMG_22.png", "a\nb", "x.tar.gz"]
    patterns = list({"".join(rng.choice("ab.*?[]!-^Z9é") for _ in range(rng.randint(1, 7))) for _ in range(500)}) + ["*", "?", "IMG_*.png", "IMG_?.png", "*.p[mn]g", "[!I]*", "[z-a]", "[!z-a]", "[a-]", "[]]", "[!]", "[", "x.*.gz", None, "a.*", "[[]*", "[\\d]"]
    got = sorted(tuple(r) for r in curation.glob_matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string")).collect())
    assert got == sorted({(p, n) for p in patterns if p and any(c in p for c in "*?[]") for n in names if fnmatch.fnmatchcase(n, p)})


def test_missing_paths_by_pattern(spark):
    found = spark.createDataFrame([("n", "/v/a.png"), ("n", "/v/x/b.png"), ("n", "/v/x/c*.pdf"), ("m", "/v/no.md"), ("m", "/v/q?.md")], "path string, resolved string")
    files = spark.createDataFrame([("/v/a.png",), ("/v/1/b.png",), ("/v/2/b.png",), ("/v/c1.pdf",), ("/v/3/c.pdf",), ("/v/c.png",)], "abs_path string")
    assert sorted(tuple(r) for r in curation.matched_paths(found, files).collect()) == [("m", "/v/no.md"), ("m", "/v/q?.md"), ("n", "/v/1/b.png"), ("n", "/v/2/b.png"), ("n", "/v/3/c.pdf"), ("n", "/v/a.png"), ("n", "/v/c1.pdf")]


def test_renames_by_lengths_and_by_endings_agree(spark, monkeypatch):
    notes = spark.createDataFrame([("a", "![x](p/long name.png) ![[b.png|1]] [y](b.png) ![z](xb.png)"), ("b", "![x](p/other.png)"), ("c", "![x]()")], "path string, content string")
    renames = spark.createDataFrame([("b.png", "c$1.png"), ("long name.png", "s.png"), ("", "none")], "old string, new string")
    want = sorted(tuple(r) for r in references.renamed(notes, renames).collect())
    assert want == [("a", 2, "![x](p/s.png) ![[c$1.png|1]] [y](c$1.png) ![z](xc$1.png)")]
    monkeypatch.setattr(references, "MOST_LENGTHS", 0)
    assert sorted(tuple(r) for r in references.renamed(notes, renames).collect()) == want


def test_collision_numbers_of_one_hot_name(spark, monkeypatch):
    """By one window a name and by ranges: the same numbers, and those of the rule played through."""
    rng = random.Random(3)
    paths = sorted({f"{rng.randrange(10**6)}/a.md" for _ in range(300)}) + ["x/a_3.md", "y/a_3.md", "x/a_7.md", "q/b.md", "r/b.md", "s/.hid", "t/.hid"]
    taken = ["a.md", "a_1.md", "a_2.md", "a_40.md", "b_1.md", "a_9999.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(4)
    there = spark.createDataFrame([(t,) for t in taken], "name string")
    got = {r["path"]: r["dest_path"] for r in plan.free_destinations(rows, "path", "t", there).collect()}
    monkeypatch.setattr(plan, "MOST_EQUAL", 0)
    assert got == {r["path"]: r["dest_path"] for r in plan.free_destinations(rows, "path", "t", there).collect()}
    names = {p.split("/")[1] for p in paths} | set(taken)
    free = [f"t/a_{k}.md" for k in range(1, 400) if f"a_{k}.md" not in names]
    assert [got[p] for p in paths if p.endswith("/a.md")] == free[:300]
    assert got["q/b.md"] == "t/b.md" and got["r/b.md"] == "t/b_2.md" and got["y/a_3.md"] == "t/a_3_1.md" and got["t/.hid"] == "t/.hid_1"
    assert len(set(got.values())) == len(paths)


def test_hashtag_table_in_sql(spark):
    from noteforge.functions import arrow

    spark.createDataFrame([("a", "#x y\n```\n#no\n``` #z"), ("b", None), ("c", "[[#w]] `#v`")], "path string, content string").createOrReplaceTempView("tagged_notes")
    spark.udtf.register("inline_hashtags", arrow.hashtag_table())
    rows = spark.sql("SELECT path, h.* FROM tagged_notes, LATERAL inline_hashtags(content) h").collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, 2, "x"), ("a", 17, 19, "z")]


def test_pixel_samples_are_bounded(spark):
    from noteforge.operators import media

    px = spark.range(5000).select(F.when(F.col("id") < 4000, "big").otherwise("small").alias("img"), F.col("id").alias("at"), F.lit(9).alias("r"), F.lit(9).alias("g"), F.lit(9).alias("b")).repartition(5)
    sample = media.sampled_pixels(px, ["img"], "at", 1000)
    assert {r["img"]: r["count"] for r in sample.groupBy("img").count().collect()} == {"big": 1000, "small": 1000}
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    assert {r["img"]: r["is_gray"] for r in media.is_gray(px, ["img"], "at").collect()} == {"big": True, "small": True}


def test_flags_of_replies_by_kind(spark):
    from noteforge.operators import providers

    kinds = [('"false"', True), ("false", False), ("true", True), ('""', False), ("null", False), ("0", False), ("0.0", False), ("2", True), ("[]", False), ("[0]", True), ("{}", False), (None, None), ('"0"', True)]
    rows = [(i, "{" + ("" if v is None else f'"is_valuable": {v}, "has_framework": {v}, ') + '"reasoning": "r"}') for i, (v, _) in enumerate(kinds)]
    got = spark.createDataFrame(rows, "i int, reply string").select("i", *providers.analysis_of()).orderBy("i").collect()
    assert [(r["is_valuable"], r["has_framework"]) for r in got] == [(True, False) if w is None else (w, w) for _, w in kinds]


def test_providers_that_hang_are_given_up(spark):
    from noteforge.operators import providers

    def reply(prompts):
        time.sleep(60 if "slow" in prompts else 0)
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("slow",), ("fast",)], "prompt string").repartitionByRange(2, "prompt")
    began = time.time()
    got = sorted(tuple(r) for r in providers.with_provider(rows, "prompt", reply, retries=1, wait=0.0, seconds=0.5).collect())
    assert got == [("fast", "FAST"), ("slow", None)] and time.time() - began < 40


def test_blocks_of_name_patterns(spark):
    """Signs at both ends leave the characters between them as a block; without any sign's freedom the length is known."""
    want = {"[!a-e]ile 12[2-4].p*": ("start", 1, "ile 12", -1), "file 12?.png": ("start", 0, "file 12", 12), "*abc*": ("in", 0, "abc", -1), "a*long one*": ("in", 0, "long one", -1), "*.p[mn]gz?": ("end", 4, ".p", -1), "[*": ("start", 0, "[", -1), "??": ("any", 0, "", 2), "*": ("any", 0, "", -1)}
    assert {p: curation.glob_block(p) for p in want} == want
    names = [f"file {i}.png" for i in range(300)]
    patterns = [*want, *(f"[!a-e]ile {i}[2-4].p*" for i in range(30))]
    got = curation.glob_matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((p, n) for p in set(patterns) for n in names if fnmatch.fnmatchcase(n, p))


def test_a_text_is_searched_once_for_signs_and_keeps_its_row(spark, sf):
    """Signs are counted for a decision once, and trigrams neither make rows of their own nor a join."""
    from noteforge import catalog

    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan_of(catalog.QUERIES["lang_decision"](spark, sf)).count("regexp_extract_all") <= 3  # both word lists, the characters
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = plan_of(language.fit(docs).detect(docs, "doc_id", "text"))
    assert "Generate" not in found and "Join" not in found


def test_detector_by_pieces_of_odd_texts(spark, monkeypatch):
    """Pieces of a batch, texts without letters, surrogates and long runs of signs: scores as by the join."""
    asked = ["", None, "a", "ab", "\U0001d400bc \U0001d401", "1" * 30_000 + "été", "Ünï \u0130x", "niño y año", "the cat sat"]
    rows = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(asked)], "id long, text string, lang string")
    got = {}
    for most, piece in ((400_000, 500_000), (400_000, 3), (0, 500_000)):
        monkeypatch.setattr(language, "MOST_BROADCAST", most)
        monkeypatch.setattr(language, "PIECE", piece)
        m = language.fit(rows)
        got[most, piece] = m.names, m.unseen, m.prior, sorted(map(str, m.grams.collect())), sorted(map(str, m.detect(rows, "id", "text").collect()))
    assert got[400_000, 500_000] == got[400_000, 3] == got[0, 500_000]


def test_found_paths_are_read_once(spark):
    """Paths that come from texts are not looked for again for those that exist and those that don't."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        seen.add(1)
        return x

    found = spark.createDataFrame([("n", "/v/a.png"), ("n", "/v/x/b.png"), ("m", "/v/q?.md")], "path string, resolved string").select("path", slow("resolved").alias("resolved"))
    files = spark.createDataFrame([("/v/a.png",), ("/v/1/b.png",), ("/v/1/b.png",)], "abs_path string")
    assert sorted(map(tuple, curation.matched_paths(found, files).collect())) == [("m", "/v/q?.md"), ("n", "/v/1/b.png"), ("n", "/v/a.png")]
    assert seen.value == 3
