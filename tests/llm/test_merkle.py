"""The Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from noteforge.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.COLUMNS)))


def climb(hashes, fan):
    """The top of a tree and each leaf's (left, right) siblings by level."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // fan * fan : a // fan * fan + fan]
            steps[i].append(("".join(run[: a % fan]), "".join(run[a % fan + 1 :])))
            at[i] = a // fan
        level = [h("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return (level or [None])[0], steps


def plain(rows, fan):
    """(doc_id, lang, leaf, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]], fan)
    root, above = climb([trees[g][0] for g in names], fan)
    return [(d, g, x, trees[g][0], root, s + above[i]) for i, g in enumerate(names) for (d, x), s in zip(groups[g], trees[g][1], strict=True)]


def found(df, fan):
    return [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in merkle.manifest(df, fan=fan).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fan", [2, 8])
def test_manifest_is_the_plain_tree(spark, fan):
    rows = [(i * 7 % 331, f"text {i} É", ["en", "fr", None, "é", "z", "Z"][i % 6] if i % 3 else "en", None if i % 5 == 0 else "s", i) for i in range(331)]
    rows += [(500, "alone", "one", "s", 1), rows[4], rows[4], (None, None, None, None, None), (None, None, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = found(df, fan)
    assert ordered(got) == ordered(plain([r.asDict() for r in df.collect()], fan))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_sizes_at_the_runs_ends(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    assert ordered(found(df, 8)) == ordered(plain([r.asDict() for r in df.collect()], 8))


def test_odd_rows_and_none(odd_docs, no_docs):
    rows = [r.asDict() for r in odd_docs.collect()]
    assert ordered(found(odd_docs, 8)) == ordered(plain(rows, 8))
    assert merkle.manifest(no_docs).count() == 0


def test_a_change_is_found_where_it_is(spark):
    """Every row's proof leads to the root; with a leaf of another text it doesn't."""
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), F.lit(None).cast("string").alias("source"), F.col("id").alias("n_chars"))
    out = merkle.manifest(df, more={"other": merkle.digest(F.lit("x"))})
    assert out.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 100
    assert out.where(merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).count() == 0


def test_query(spark, sf):
    from zlib import crc32

    rows = {r["doc_id"]: r for r in merkle.op11_merkle_manifest(spark, sf).collect()}
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {r[0]: r for r in plain(docs, 8)}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert len(rows) == len(docs)
    for d in docs:
        _, _, own, subroot, root, proof = want[d["doc_id"]]
        node = leaf(d | {"text": d["text"] and d["text"].translate(lower)}) if crc32(str(d["doc_id"]).encode()) % 3 == 0 else own
        for left, right in proof:
            node = h(left + node + right)
        r = rows[d["doc_id"]]
        assert tuple(r) == (d["doc_id"], own, subroot, root, h("".join(a + b for a, b in proof)), node, node == root)
    assert {r["verified"] for r in rows.values()} == {True, False}
