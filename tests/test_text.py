"""Column and Arrow functions on hand-written notes; expected values by hand or from the standard library."""

import difflib

import pytest
from pyspark.sql import functions as F

from noteforge import vocab
from noteforge.functions import arrow, text
from noteforge.operators import curation, stats


def values(spark, rows, *columns, ddl="c string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], ddl).select(*columns).collect()]


def test_duplicate_names(spark):
    base, n = text.duplicate_name(F.col("c"))
    got = values(spark, ["n.md", "n (1).md", "n (1) (2).md", "n 1.md", "m (3).md"], base, n)
    assert got == [("n", 0), ("n", 1), ("n (1)", 2), ("n 1", 0), ("m", 3)]


def test_lines_as_splitlines(spark):
    cases = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x85f g", "\n\n", "a\n\nb"]
    assert [r[0] for r in values(spark, cases, text.lines(F.col("c")))] == [c.splitlines() for c in cases]


def test_links(spark):
    note = "[[i.png]] [[i.png|200]] [[sub/i.png]] [[ | x]] ![](../Attachments/sub/i.png?w=1) [a](b) ![](ATTACHMENTS/i.png)"
    ((wiki, md),) = values(spark, [note], text.wiki_links(F.col("c")), text.md_links(F.col("c")))
    assert wiki == ["i.png", "i.png", "sub/i.png"]
    assert [x["url"] for x in md] == ["../Attachments/sub/i.png?w=1", "b", "ATTACHMENTS/i.png"]
    got = values(spark, ["../Attachments/sub/i.png?w=1", "ATTACHMENTS/i.png", "b", None], text.attachment_path(F.col("c")))
    assert [r[0] for r in got] == ["sub/i.png", "i.png", None, None]


def test_names(spark):
    names = ["Screenshot 2024-01-02 at 9.15.30.png", "IMG_1234.JPG", ".bashrc", "a.", "ab.png", "x.tar.GZ"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, file string")
    assert [r[0] for r in df.select(stats.suffix(F.col("file"))).collect()] == ["png", "jpg", "no extension", "no extension", "png", "gz"]
    flags = stats.name_flags(df).collect()
    assert [r["date_time"] for r in flags] == [True, False, False, False, False, False]
    assert [r["short_name"] for r in flags] == [False, False, False, True, True, False]
    assert sorted(r["file"] for r in stats.screenshots(df).collect()) == ["IMG_1234.JPG", names[0], names[0]]


def test_frontmatter_dialects(spark):
    note = '---\ntitle: "T: x"\ntags: [a]\ntitle: y\n---\nbody --- more\n'
    got = values(spark, [note, "no", "---\nopen"], text.frontmatter_map(F.col("c")), text.any_dash_end(F.col("c")), text.has_frontmatter(F.col("c")), text.body_of(F.col("c")))
    assert got[0] == ({"title": "y", "tags": "[a]"}, note.index("---", 3) + 3, True, "body --- more\n")
    assert got[1] == (None, 0, False, "no") and got[2][1] == 0


def test_tags(spark):
    note = "---\ntags: ['ppp', 'innovation', 'risk-analysis', 'risk', \"lang/en\"]\n---\n"
    df = spark.createDataFrame([("p", note), ("q", "tags: []\n")], "path string, content string")
    rows = {r["tag"]: r["mapped"] for r in curation.tag_rows(df).collect()}
    assert rows == {"ppp": "topic/ppp", "innovation": None, "risk-analysis": "topic/risk", "risk": "topic/risk", "lang/en": "lang/en"}
    (done,) = curation.normalised_notes(df).collect()
    assert done["new_content"] == "---\ntags:\n  - lang/en\n  - topic/ppp\n  - topic/risk\n---\n" and (done["n_kept"], done["n_removed"]) == (3, 1)
    assert len(vocab.APPROVED_TAGS) == len(set(vocab.APPROVED_TAGS)) == 70 and len(vocab.TAG_MAPPING) == 181
    assert sum(v is None for v in vocab.TAG_MAPPING.values()) == 49


def test_language_tag_rewrites(spark):
    cases = ["---\ntags: ['a', 'lang/en']\n---\nx", "---\ntags: [a]\n---\nx", "---\ntags: []\n---\nx", "---\ntags:\n  - a\n---\nx", "---\nt: 1\n---\nx", "x"]
    got = [r[0] for r in values(spark, cases, text.with_language(F.col("c"), F.lit("es")))]
    assert got == ["---\ntags: ['a', 'lang/es']\n---\nx", "---\ntags: [a, 'lang/es']\n---\nx", "---\ntags: ['lang/es']\n---\nx", "---\ntags:\n  - a\n---\n  - lang/es\nx", "---\nt: 1\n---\nx", "x"]


def test_long_lists_do_not_overflow(spark):
    note = "---\ntags:\n" + "  - t\n" * 20_000 + "---\nx"
    ((n, plain),) = values(spark, [note], F.length(text.with_language(F.col("c"), F.lit("en"))), F.length(text.plain_text(F.lit("a" * 300_000))))
    assert n == len(note) + len("  - lang/en\n") and plain == 300_000


def test_plain_text_order(spark):
    got = [r[0] for r in values(spark, ["[a](http://x) y", "![alt](u) **b** `c` [[l|t]] [[m]]", "# H\n\n_e_ <b>"], text.plain_text(F.col("c")))]
    assert got == ["[a]( y", "!alt b t m", "H e"]


def test_archive(spark):
    df = spark.createDataFrame([("n", "chatgpt x.md", "hola ¿qué?"), ("o", "proyecto.md", "a" * 5001 + "\n## x" * 3)], "path string, name string, content string")
    rows = {r["path"]: r for r in curation.archive_rows(df, "2024-01-01").collect()}
    assert (rows["n"]["lang"], rows["n"]["kind"], rows["n"]["usefulness"]) == ("lang/es", "type/chatgpt-conversation", 0.5)
    assert rows["o"]["usefulness"] == 0.9 and "topic/ai" in rows["n"]["topics"]


@pytest.mark.parametrize("score", [0.3, 0.35, 0.35 + 0.1, 0.5, 0.55, 0.65, 0.7 - 0.15, 0.65 - 0.15 + 0.1, 0.7, 0.7 + 0.15, 0.75, 0.8, 0.9])
def test_score_text(spark, score):
    assert values(spark, [score], text.score_text(F.col("c")), ddl="c double") == [(f"{score:.1f}",)]


def test_paths(spark):
    note = "[[a.png|x]] (/abs/p) `/tick` \n/line,\n<b.md> dir/x.png"
    ((found,),) = values(spark, [note], text.extracted_paths(F.col("c")))
    assert found[:4] == ["a.png", "/abs/p", "/tick", "/line"] and "b.md" in found and "dir/x.png" in found and "/x.png" in found
    got = [r[0] for r in values(spark, ["/Users/a", "/f.png", "x/../y", "./z"], text.resolved_path(F.col("c"), "/v"))]
    assert got == ["/Users/a", "/v/f.png", "/v/y", "/v/z"]


def test_transcripts(spark):
    chat = "### User, on T1;\n> q1\n#### ChatGPT, on T2;\n>> a1\nmore\n<details>x\n### User, on T3;\n> q2\n"
    ((m,),) = values(spark, [chat], text.transcript_messages(F.col("c")))
    assert [(x["role"], x["stamp"], x["content"]) for x in m] == [("user", "T1", "q1"), ("user", "T3", "q2"), ("assistant", "T2", "a1\nmore")]


def test_hashtags(spark):
    note = "---\nt: #no\n---\n#general #topic/new #Foo/bar `#a` [[x #y]] [t](/#v) a#b\n```\n#c\n```\n#🚀lib"
    assert [t for _, _, t in arrow.find_hashtags(note)] == ["general", "🚀lib"]
    ((once, twice),) = spark.createDataFrame([(note,)], "c string").select(arrow.escape_hashtags("c").alias("c")).select("c", arrow.escape_hashtags("c")).collect()
    assert "`#general`" in once and once == twice


def test_similarity_is_difflib(spark):
    a = "\n".join(f"line {i}" for i in range(20))
    b = a.replace("line 3\n", "other\n")
    got = spark.createDataFrame([(a, b), (a, a), ("", "")], "a string, b string").select(arrow.line_similarity("a", "b")).collect()
    assert [r[0] for r in got] == [difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).ratio(), 1.0, 1.0] and got[0][0] == 0.95


def test_yaml_and_json(spark):
    assert arrow.small_yaml("---\nname: a\ndescription: |\n  x\nmodel: opus\n---\nbody") == {"name": "a", "description": "x\nmodel: opus"}
    assert arrow.json_object('Sure ```json\n{"a": {"b": 1}}\n``` x') == '{"a": {"b": 1}}'
    assert arrow.json_object("none") is None and arrow.json_object('{"a": "}"}') is None


def test_hidden_policies(spark):
    paths = ["a.md", ".trash/t.md", ".obsidian/o.md", ".claude/a.md", "_n.md"]
    left = lambda p: [r[0] for r in spark.createDataFrame([(x,) for x in paths], "c string").where(~text.is_hidden(F.col("c"), p)).collect()]
    assert left("shared") == ["a.md", "_n.md"] and left("inverted") == ["a.md", ".trash/t.md", ".obsidian/o.md", "_n.md"]
    assert left("fallback") == ["a.md", ".claude/a.md", "_n.md"] and left("none") == paths


@pytest.mark.parametrize(
    "note,tags",
    [
        ("[[x]](http://e/ #general) #b", ["b"]),  # the address starts behind ]]
        ("](a (b #general", ["general"]),  # the last ( follows no ]
        ("[[a [[b]] #c", ["c"]),
        ("[[open #a\n#b]] #c", ["c"]),
        ("`a #b` #c ` #d\n#e", ["c", "e"]),
        ("```\n#a\n```\n#b ``` #c", ["b"]),
        ("x ``` `#a #b\n``` #c", ["c"]),
        ("---\n#t\n---\n#a/b #c", ["c"]),
    ],
)
def test_hashtag_contexts(note, tags):
    assert [t for _, _, t in arrow.find_hashtags(note)] == tags


def test_small_yaml_rules():
    note = "---\nname: \"\"\nplain: it's 'x'\nquoted: \"a \"\nempty:\nlong: a\n  b\nlong:\nd: |\n  x\n    y: z\n---\n"
    assert arrow.small_yaml(note) == {"name": "", "plain": "it's 'x'", "quoted": "a", "long": "a\nb", "d": "x\n    y: z"}


@pytest.mark.parametrize("below,broken", [("loose", True), ("  more", False), ("key: v", False), ("\n\n\nloose", True), ("\n\n\n\n\nloose", False), ("---\nloose", False)])
def test_bare_descriptions(spark, below, broken):
    note = f"---\nname: a\ndescription: bare\n{below}\n---\ndescription: bare\nloose\n"
    rows = curation.agent_rows(spark.createDataFrame([("a", note)], "path string, content string"), spark.createDataFrame([], "skill string"))
    assert (rows.first()["errors"] == ["Description spans lines without quotes"]) == broken


def test_long_chapters_are_cut(spark):
    points = "\n".join(f"- **p{i}** {'x' * 90}" for i in range(9))
    note = f"---\nbook: B\n---\n## Chapter Overview\n\n{'o' * 900}\n\n## Key Arguments\n\n{points}\n\n## Core Concepts\n\nnone\n"
    r = curation.chapter_prompts(spark.createDataFrame([("c", note)], "path string, content string"), "STYLE").first()
    assert (r["title"], r["book"], r["points"], r["headers"]) == ("Chapter Summary", "B", 6, 0)
    assert "\n" + "o" * 400 + "\n" in r["prompt"] and "- p5\n\nMAIN" in r["prompt"] and r["prompt"].endswith("STYLE\n")
    assert r["prompt"].count("- p3") == 2 and r["prompt"].count("- p4") == 1


def test_whole_notes_go_to_workers_a_few_at_a_time(spark):
    df = spark.createDataFrame([("#x y",), (None,)], "c string").select(arrow.escape_hashtags("c").alias("e"), arrow.hashtags("c").alias("h"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [(r["e"], [tuple(h) for h in r["h"]]) for r in df.collect()] == [("`#x` y", [(0, 2, "x")]), (None, [])]


def test_agent_files_are_parsed_by_one_worker_a_task(spark):
    files = [("a", '---\nname: n\ndescription: "<example>"\nmodel: opus\nskills: x, y\n---\nb'), ("a", "---\nskills: z\n---\n"), ("none", "no frontmatter"), ("null", None), (None, "---\nname: m\nskills: q\n---\nb")]
    got = curation.agent_rows(spark.createDataFrame(files, "path string, content string").repartition(2), spark.createDataFrame([("x",)], "skill string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 2  # one for the rows and one for their skills, in stages of their own
    rows = {(r["path"], r["name"]): (r["valid"], r["warnings"]) for r in got.collect()}
    both = ["Missing skill: y", "Missing skill: z"]
    assert rows == {("a", "n"): (True, both), ("a", None): (False, ["No model", "Empty body", *both]), ("none", None): (False, []), ("null", None): (False, []), (None, "m"): (False, ["No model"])}
