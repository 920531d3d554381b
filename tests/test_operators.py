"""Operators on small relations: duplicates, references, plans, reports, media, sources, providers, streams."""

import os

import pytest
from pyspark.sql import functions as F

from noteforge.operators import curation, dedup, media, providers, references, reports, stats
from noteforge.plans import plan
from noteforge.sources.vault import VaultSource
from noteforge.streaming import increments


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_name_groups_promote_the_lowest(spark):
    notes = spark.createDataFrame([(1, "n.md", "n.md"), (2, "n (1).md", "n (1).md"), (3, "sub/n.md", "n.md"), (4, "m (3).md", "m (3).md"), (5, "z.md", "z.md")], "doc_id long, path string, name string")
    got = {r["path"]: r["is_original"] for r in dedup.name_groups(notes).collect()}
    assert got == {"n.md": True, "n (1).md": False, "sub/n.md": False, "m (3).md": True}


def test_kept_copy_and_orphans(spark):
    att = spark.createDataFrame([("a/x.png", "x.png", 5, "h"), ("b/y.png", "y.png", 5, "h"), ("z.png", "z.png", 1, "k")], "rel_path string, name string, size long, hash string")
    notes = spark.createDataFrame([("n.md", "[[y.png]]")], "path string, content string")
    assert rows(dedup.keep_one(att, "rel_path"), "rel_path", "is_kept") == [("a/x.png", True), ("b/y.png", False)]
    assert rows(references.orphans(notes, att), "rel_path", "via_copy") == [("a/x.png", True), ("z.png", False)]
    used = references.references(notes, att)
    assert references.orphans(notes, att).join(used, "rel_path", "left_semi").count() == 0


def test_renames(spark):
    notes = spark.createDataFrame([("n.md", "![[a.png|x]] [[a.png]] ![](Attachments/a.png?w=1) [t](x/ba.png) b.png"), ("m.md", "none")], "path string, content string")
    (r,) = references.renamed(notes, spark.createDataFrame([("a.png", "a.jpg")], "old string, new string")).collect()
    assert r["new_content"] == "![[a.jpg|x]] [[a.png]] ![](Attachments/a.png?w=1) [t](x/ba.jpg) b.png"


def test_collisions_are_numbered(spark):
    files = spark.createDataFrame([("1/a.md",), ("2/a.md",), ("3/a.md",), ("4/a_1.md",)], "path string")
    dest = [r["dest_path"] for r in plan.free_destinations(files, "path", ".trash").collect()]
    assert len(set(dest)) == 4 and ".trash/a.md" in dest and ".trash/a_1.md" in dest


def test_apply_needs_confirmation(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    p = plan.plan(spark.createDataFrame([("a.md", "t/a.md"), ("no.md", "t/no.md"), ("../out", "t/o")], "src string, dest string"), "test", "MOVE", "src", dest_path="dest")
    with pytest.raises(ValueError):
        plan.apply(p, str(tmp_path))
    assert sorted(plan.apply(p, str(tmp_path), confirm=True)) == [("../out", "OUTSIDE"), ("a.md", "DONE"), ("no.md", "MISSING")]
    assert (tmp_path / "t/a.md").read_text() == "x"


def test_snapshots(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "")], "path string, hash string")
    b = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("e", "5")], "path string, hash string")
    assert rows(reports.snapshot_diff(s, b), "path", "status") == [("a", "new"), ("b", "unchanged"), ("c", "modified"), ("d", "orphan"), ("e", "error")]


@pytest.mark.parametrize("n,p,value", [(4, 50, 3), (100, 99, 100), (100, 50, 51)])
def test_nearest_rank(spark, n, p, value):
    assert [r["value"] for r in stats.nearest_rank(spark.range(1, n + 1), "id", (p,)).collect()] == [value]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "type string, size long")
    assert tuple(stats.stats_overall(empty).first()) == (0, 0, 0.0)
    convs = stats.conversation_rollup(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert all(r["coverage_pct"] == 0 for r in stats.coverage(convs).collect()) and len(stats.length_histogram(convs).collect()) == 5


def test_media(spark):
    px = spark.createDataFrame([("p", float(i), float(i)) for i in range(50)], "img string, x double, y double")
    assert rows(media.ssim(px, ["img"], "x", "y"), "ssim") == [(1.0,)]
    w, h = media.resized(F.col("w"), F.col("h"))
    got = spark.createDataFrame([(2000, 1000), (2000, 2000), (100, 50)], "w int, h int").select(w, h).collect()
    assert [tuple(r) for r in got] == [(1440, 720), (1440, 1440), (100, 50)]


def test_vault_source_sees_all_files(spark, tmp_path):
    for p in ("a.md", ".trash/x/t.md", ".claude/agents/a.md", "_n.md", "e.md", "#h?.md"):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text("" if p == "e.md" else "x")
    spark.dataSource.register(VaultSource)
    read = lambda **o: spark.read.format("vault").options(**o).load(str(tmp_path))
    assert rows(read(), "rel_path") == [("#h?.md",), ("_n.md",), ("a.md",), ("e.md",)]
    assert rows(read(policy="none", relation="contents"), "rel_path", "content")[1][0] == ".claude/agents/a.md"
    assert read(trash="true").count() == 5 and read().where("md5 = 'd41d8cd98f00b204e9800998ecf8427e'").first()["rel_path"] == "e.md"


def test_providers(spark):
    def reply(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError
        return ['x {"quality_score": "85", "suggested_action": "archive", "has_framework": true}' for _ in prompts]

    got = providers.with_provider(spark.createDataFrame([("p",)], "prompt string"), "prompt", reply).select(*providers.analysis_of()).first()
    assert tuple(got) == (85.0, "archive", "", True, True, [], None, [])
    bad = providers.with_provider(spark.createDataFrame([("boom",)], "prompt string"), "prompt", reply, wait=0.0).select(*providers.analysis_of()).first()
    assert tuple(bad) == (50.0, "review", "Error parsing LLM response", False, True, [], None, [])


def test_stream_counts_equal_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    q = increments.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("counts"), "start", "event_type", "events") == rows(increments.tumbling_counts(events), "start", "event_type", "events")
    finally:
        q.stop()


def test_queries_leave_no_document_out(spark, tmp_path):
    from noteforge import catalog

    sizes = [(1, 10), (2, 5 << 20), (3, 3 << 30), (4, 2 << 40), (6, 7)]
    spark.createDataFrame([(i, "text", "en", "s", n) for i, n in sizes], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(catalog.QUERIES["human_sizes"](spark, str(tmp_path)), "doc_id", "shown") == [(1, "10.00 B"), (2, "5.00 MB"), (3, "3.00 GB"), (4, "2.00 TB"), (6, "7.00 B")]
    assert ("s/note 1 (2).md", "/vault/Attachments/img/file 6.png") in rows(catalog.QUERIES["basename_match"](spark, str(tmp_path)), "path", "resolved")


def test_chapters_hold_whole_texts(spark, tmp_path):
    import hashlib

    from noteforge import catalog

    texts = {1: "word " * 500 + "end", 2: "short", 3: "x" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tail = "\n\n## Key Arguments\n\n- **first** a\n- **second** b\n\n## Key Concepts\n\n### one\n\n### two\n"
    want = {f"c{i}": f'---\ntitle: "Chapter {i}"\n---\n## Chapter Overview\n\n![[c{i}.png]]\n\n{t}{tail}' + "![[x diagram.png]]\n" * (i % 3 == 0) for i, t in texts.items()}
    assert rows(catalog.QUERIES["insert_embed"](spark, str(tmp_path)), "path", "content_md5") == [(k, hashlib.md5(v.encode()).hexdigest()) for k, v in sorted(want.items())]
    lists = "\n\nKEY CONCEPTS TO VISUALIZE:\n- one\n- two\n\nMAIN ARGUMENTS:\n- first\n- second\n\n"
    prompts = {r["path"]: r["prompt"] for r in curation.chapter_prompts(catalog.book_chapters(spark, str(tmp_path))).collect()}
    assert sorted(prompts) == ["c1", "c2"] and all(f"\n\nOVERVIEW:\n{texts[i][:400].rstrip()}{' ' * (i == 1)}{lists}" in prompts[f"c{i}"] for i in (1, 2))


def test_orphans_are_looked_for_in_whole_contents(spark):
    names = ["a.png", "b.png", "c.png", "d.png", "e.png", "f.png"]
    found = spark.createDataFrame([(f"img/{n}", n) for n in names], "rel_path string, name string")
    text = "[[a.png]] ![[b.png]] plain (c.png), Attachments/d.png and img/e.png; f.png"
    notes = spark.createDataFrame([("n.md", text), ("m.md", None)], "path string, content string")
    assert rows(references.verified_sample(notes, found), "rel_path", "mentioned") == [(f"img/{n}", n != "f.png") for n in names]


def test_similar_notes_of_a_name_group(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    notes = [(1, "n.md", "n.md", text), (2, "n (1).md", "n (1).md", text.replace("line 7\n", "other\n")), (3, "n (2).md", "n (2).md", text), (4, "n (3).md", "n (3).md", "else\n" * 40)]
    got = {r["path"]: r["ratio"] for r in dedup.similar_to_original(spark.createDataFrame(notes, "doc_id long, path string, name string, content string")).collect()}
    assert got == {"n (1).md": 0.975, "n (2).md": 1.0}


def test_audio_embeds_follow_the_link_s_own_ending(spark):
    notes = spark.createDataFrame([("n.md", "![[r.m4a|x]] ![[r.m4a.txt]] ![](Attachments/q.m4a?w=1) ![](../attachments/s/Q.M4A) [l](Attachments/t.m4a)")], "path string, content string")
    files = spark.createDataFrame([("b/r.m4a", "r.m4a"), ("a/r.m4a", "r.m4a"), ("q.m4a", "q.m4a"), ("s/Q.M4A", "Q.M4A"), ("t.m4a", "t.m4a")], "rel_path string, name string")
    assert rows(references.audio_embeds(notes, files, ["m4a"]), "rel_path") == [("a/r.m4a",), ("s/Q.M4A",)]


def test_upsert_changes_the_first_row_of_a_path(spark):
    old = spark.createDataFrame([(1, "a", "keep", 1.0), (2, "a", "keep", 2.0), (3, "b", "keep", 3.0)], "at int, path string, action string, score double")
    new = spark.createDataFrame([("a", "archive", 9.0)], "path string, action string, score double")
    assert rows(reports.upsert(old, new, "at"), "at", "action", "score") == [(1, "archive", 9.0), (2, "keep", 2.0), (3, "keep", 3.0)]


def test_collisions_skip_taken_numbers(spark):
    paths = [*(f"{i}/a.md" for i in range(6)), "x/a_2.md", "y/a_2.md", "x/a_2_1.md", "x/a_07.md", "p/b", "q/b"]
    taken = spark.createDataFrame([("a.md",), ("a_1.md",), ("a_5.md",), ("b_1",)], "name string")
    done = plan.free_destinations(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "t", taken).collect()
    got = {r["path"]: r["dest_path"] for r in done}
    assert [got[f"{i}/a.md"] for i in range(6)] == [f"t/a_{n}.md" for n in (3, 4, 6, 7, 8, 9)]
    assert [got[p] for p in paths[6:]] == ["t/a_2.md", "t/a_2_2.md", "t/a_2_1.md", "t/a_07.md", "t/b", "t/b_2"]


def test_transparency_samples_large_images(spark):
    px = spark.createDataFrame([("big", i, 0 if i == 7 else 255) for i in range(101)] + [("small", i, 0 if i == 7 else 255) for i in range(100)] + [("hit", i, 0 if i == 100 else 255) for i in range(101)], "img string, at int, a int")
    assert rows(media.transparent(px, ["img"], "at", "a"), "img", "transparent") == [("big", False), ("hit", True), ("small", True)]


def test_nearest_rank_of_odd_columns(spark):
    one = spark.createDataFrame([(7,)] * 5, "v long")
    assert [r["value"] for r in stats.nearest_rank(one, "v", (0, 50, 99)).collect()] == [7, 7, 7]
    some = spark.createDataFrame([(None,), (-3,), (10**12,), (0,)], "v long")
    assert rows(stats.nearest_rank(some, "v", (25, 50, 75)), "percent", "value") == [(25, -3), (50, 0), (75, 10**12)]
    assert stats.nearest_rank(one.where("v < 0"), "v").count() == 0


def test_json_sinks_and_merged_text(spark, tmp_path):
    from noteforge.sources import reports as sinks

    done = spark.createDataFrame([("a", 1)], "path string, n int")
    sinks.add_results(done, f"{tmp_path}/r")
    sinks.add_results(done.withColumn("path", F.lit("b")), f"{tmp_path}/r")
    todo = spark.createDataFrame([("a",), ("c",)], "path string")
    assert rows(sinks.pending(todo, spark.read.json(f"{tmp_path}/r")), "path") == [("c",)]
    sinks.write_stats(done, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()["n"] == 1
    notes = spark.createDataFrame([(i, "g" if i % 3 else "h", f"T{i}", f"body {i}\nend") for i in range(50)], "i int, g string, t string, b string")
    sinks.write_merged(notes, "g", "t", "b", "i", f"{tmp_path}/m")
    for r in stats.merged_document(notes, "g", "t", "b", "i").collect():
        folder = tmp_path / "m" / f"g={r['g']}"
        assert "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-")) == r["merged"] + "\n"


def test_path_limit_and_preview(spark):
    from noteforge.functions import text

    notes = spark.createDataFrame([("n", "[[b.png]] [[a.png]] [[b.png]] [[c.png]]")], "path string, content string")
    assert rows(curation.path_rows(notes, "/v", "only", 2), "resolved") == [("/v/a.png",), ("/v/b.png",)]
    shown = lambda t, n: spark.createDataFrame([(t,)], "t string").select(text.preview(F.col("t"), n)).first()[0]
    for t in ("# T\nab\ncd\nef", "ab\ncd", "", "# T\n", "x" * 9 + "\ny"):
        for n in range(1, 12):
            body, kept, used = t.removeprefix("# T\n"), [], 0
            for line in body.split("\n"):
                if used >= n:
                    kept.append("\n[... conversation continues ...]")
                    break
                kept.append(line)
                used += len(line) + 1
            assert shown(t, n) == "\n".join(kept)


def test_gray_detection_counts_every_pixel(spark, tmp_path):
    from noteforge import catalog

    rows = [(i, i % 7, float(i % 50), "A" if i % 3 else "N", i, i, (i % 11) / 100) for i in range(6000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spread = {flag: [abs(r - 10 * g) + abs(10 * g - 1000 * b) + abs(r - 1000 * b) for _, g, r, f, _, _, b in rows if f == flag] for flag in "AN"}
    got = {r["l_returnflag"]: r["variance"] for r in catalog.QUERIES["gray_detection"](spark, str(tmp_path)).collect()}
    assert got == {flag: pytest.approx(sum(x) / (3 * len(x)), abs=1e-6) for flag, x in spread.items()}


def test_quality_adds_pages_in_their_order(spark):
    """Whatever the order of rows and tasks: some means are equal to the threshold, and doubles fall to either side."""
    import itertools

    lists = {f"{k}-{j}": order for k, xs in enumerate(([50, 39, 49, 46], [45, 47, 46])) for j, order in enumerate(itertools.permutations(xs))}
    rows = [(pdf, i, x / 50) for pdf, xs in lists.items() for i, x in enumerate(xs)] + [("none", 0, None), ("none", 1, None)]
    want = {"none": 1.0}
    for pdf, xs in lists.items():
        total = 0.0
        for x in xs:
            total += x / 50
        want[pdf] = total / len(xs)
    assert {x >= 0.92 for x in want.values()} == {True, False}
    for parts in (1, 7):
        scores = spark.createDataFrame(rows[::-1], "pdf string, page int, ssim double").repartition(parts, "page")
        assert {r["pdf"]: (r["ssim"], r["passed"]) for r in media.quality(scores, at=["page"]).collect()} == {pdf: (x, x >= 0.92) for pdf, x in want.items()}
