"""Merkle manifests: a hash tree over the rows of each group and over the groups' roots, with a proof for every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.llm.common import lower_ascii, numbered, stored, with_row_keys

#: Consecutive nodes that share a parent.
FAN = 8
#: What a leaf's hash covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """SHA-256 in lowercase hex of the values one after another: `-` for null, else the UTF-8 byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def climb(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (_group, _pos from 0, _n nodes in the group, _hash) and the groups' tops (_group, _hash).

    A window over group and parent index lists each run's hashes in order. The list is the parent's preimage and holds
    its children's siblings; of the run's equal parents one goes up. A run is `fan` rows at most, so no task holds a
    group, whatever its share of the rows. A group that is down to one node goes no further."""
    levels, tops, level = [], nodes.where("_n = 1").select("_group", "_hash"), nodes
    run = W.partitionBy("_group", F.expr(f"_pos div {fan}")).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    most = nodes.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        runs = level.where("_n > 1").select("_group", "_pos", "_n", F.collect_list("_hash").over(run).alias("_kids"))
        parents = runs.where(f"_pos % {fan} = 0").select("_group", F.expr(f"_pos div {fan}").alias("_pos"), F.expr(f"(_n + {fan - 1}) div {fan}").alias("_n"), F.sha2(F.array_join("_kids", ""), 256).alias("_hash"), "_kids")
        level = stored(parents, "merkle-level")
        levels.append(level)
        tops = tops.unionByName(level.where("_n = 1").select("_group", "_hash"))
        most = math.ceil(most / fan)
    return levels, tops


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """nodes with _steps, the siblings at each level up to the group's top and on, and the other columns of above
    (_group, _steps and more, for each group's top). Paths grow from the tops down; a path is joined to the children of
    one node at a time, so a large group is no hot key."""
    more = [c for c in above.columns if c != "_group"]
    tops = above.select(F.col("_group").alias("_g"), *more)
    own = F.struct(F.array_join(F.expr(f"slice(_k, 1, cast(_pos % {fan} as int))"), "").alias("left"), F.array_join(F.expr(f"slice(_k, cast(_pos % {fan} as int) + 2, {fan})"), "").alias("right"))
    down = None
    for level in [*reversed(levels), nodes]:
        kept = [F.col(c) for c in level.columns]
        here = level.where("_n = 1").join(tops, F.col("_group").eqNullSafe(F.col("_g"))).select(*kept, *more)
        if down is not None:
            parents = down.select(F.col("_group").alias("_g"), F.col("_pos").alias("_p"), F.col("_kids").alias("_k"), *more)
            below = level.where("_n > 1").join(parents, F.col("_group").eqNullSafe(F.col("_g")) & (F.expr(f"_pos div {fan}") == F.col("_p")))
            here = here.unionByName(below.withColumn("_steps", F.concat(F.array(own), "_steps")).select(*kept, *more))
        down = here
    return down


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, fan: int = FAN, more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: `order`, `group`, leaf, subroot, root, proof, and the columns of `more`, which are
    computed on docs' rows. leaf is digest() of the columns; proof lists, from the leaf's run to the root, the hashes
    left and right of the own one.

    Per group, leaves stand in ascending `order`, equal ones by leaf; groups stand by name in UTF-8 bytes, null first. A
    null group is a group of its own, a null `order` comes first. Repeated rows are leaves of their own with equal
    proofs. A group of one row has its leaf as subroot; an only group's subroot is the root; without siblings proof is
    empty or has empty sides. Very long texts are hashed whole where they lie: only hashes are shuffled. An empty table
    gives no rows; other columns, whatever their names, play no part."""
    more = more or {}
    keyed, keys = with_row_keys(docs)
    leaves = keyed.select(keyed[group].alias("_group"), keyed[order].alias("_order"), digest(*[keyed[c] for c in columns]).alias("_hash"), *[c.alias(f"_more_{n}") for n, c in more.items()], *[keyed[k].alias(f"_key_{i}") for i, k in enumerate(keys)])
    placed = numbered(stored(leaves, "merkle-leaves"), ["_group"], ["_order", "_hash", "_key_0", "_key_1"], "merkle-placed")
    levels, tops = climb(placed, fan)
    groups = numbered(tops.select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), "_hash"), ["_group"], ["_name"], "merkle-groups")
    upper, root = climb(groups, fan)
    root = root.select("_group", F.array().cast(STEPS).alias("_steps"), F.col("_hash").alias("_root"))
    groups = stored(descend(groups, upper, root, fan), "merkle-roots")
    above = groups.select(F.col("_name").alias("_group"), "_steps", F.col("_hash").alias("_subroot"), "_root")
    out = descend(placed, levels, above, fan)
    return out.select(F.col("_order").alias(order), F.col("_group").alias(group), F.col("_hash").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_steps").alias("proof"), *[F.col(f"_more_{n}").alias(n) for n in more])


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]))
    out = manifest(docs, more={"tampered": tampered})
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8, fan: int = FAN) -> str:
    """DuckDB SQL of op11_merkle_manifest; a tree has `levels` levels at most. The table of CRC-32 is built bit by bit."""
    value = "coalesce(octet_length(encode(cast({0} AS varchar))) || ':' || {0}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(value.format(c) for c in COLUMNS)
    bits = "c"
    ctes = ["b0 AS (SELECT i, i AS c FROM range(256) r(i))"]
    ctes += [f"b{k} AS (SELECT i, xor({bits} >> 1, 3988292384 * ({bits} & 1)) AS c FROM b{k - 1})" for k in range(1, 9)]
    ctes.append("crc AS (SELECT list(c ORDER BY i) AS t FROM b8)")
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS varchar), ''), lambda d: cast(ord(d) AS bigint))), lambda a, d: xor(a >> 8, t[xor(a, d) % 256 + 1])))"
    ctes.append(f"docs AS (SELECT doc_id, lang, sha256({leaf}) AS hash, CASE WHEN {crc} % 3 = 0 THEN sha256({leaf.replace('text', lower)}) END AS tampered FROM documents, crc)")
    ctes.append("l0 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM docs WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash))")

    def tree(name: str, group: str) -> None:
        for k in range(1, levels + 1):
            ctes.append(f"{name}{k} AS (SELECT {group}, pos // {fan} AS pos, (any_value(n) + {fan - 1}) // {fan} AS n, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, list(hash ORDER BY pos) AS kids FROM {name}{k - 1} WHERE n > 1 GROUP BY {group}, pos // {fan})")

    def proofs(name: str, group: str, above: str) -> None:
        for k in range(levels, -1, -1):
            step = f"{{'l': array_to_string(p.kids[:x.pos % {fan}], ''), 'r': array_to_string(p.kids[x.pos % {fan} + 2:], '')}}"
            parts = [f"SELECT x.*, a.* EXCLUDE (g) FROM {name}{k} x JOIN {above} a ON a.g IS NOT DISTINCT FROM x.{group} WHERE x.n = 1"]
            if k < levels:
                parts.append(f"SELECT x.*, list_prepend({step}, p.steps) AS steps, p.subroot, p.root FROM {name}{k} x JOIN {name}p{k + 1} p ON p.{group} IS NOT DISTINCT FROM x.{group} AND p.pos = x.pos // {fan} WHERE x.n > 1")
            ctes.append(f"{name}p{k} AS ({' UNION ALL '.join(parts)})")

    tree("l", "lang")
    tops = " UNION ALL ".join(f"SELECT lang, hash FROM l{k} WHERE n = 1" for k in range(levels + 1))
    ctes.append(f"u0 AS (SELECT 0 AS top, lang, hash, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM ({tops}))")
    tree("u", "top")
    ctes.append("above_all AS (SELECT 0 AS g, cast([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS steps, '' AS subroot, hash AS root FROM (" + " UNION ALL ".join(f"SELECT hash FROM u{k} WHERE n = 1" for k in range(levels + 1)) + "))")
    proofs("u", "top", "above_all")
    ctes.append("above AS (SELECT lang AS g, steps, hash AS subroot, root FROM up0)")
    proofs("l", "lang", "above")
    ctes.append("done AS (SELECT *, list_reduce(list_prepend(coalesce(tampered, hash), list_transform(steps, lambda s: s.l || '|' || s.r)), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded FROM lp0)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, hash AS leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done"


SQL_OP11 = _sql()
