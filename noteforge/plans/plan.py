"""Action plans: rows that say what would be moved, rewritten, copied or deleted, and the step that does it.

Plan columns: op, action, src_path, dest_path, group_key, reason, new_content.
"""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noteforge.operators.positions import numbered

COLUMNS = ["op", "action", "src_path", "dest_path", "group_key", "reason", "new_content"]


def plan(rows: DataFrame, op: str, action: str, src: str, **more: str | Column) -> DataFrame:
    given = {"op": F.lit(op), "action": F.lit(action), "src_path": F.col(src)} | {k: v if isinstance(v, Column) else F.col(v) for k, v in more.items()}
    return rows.select(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in COLUMNS])


#: Names with more rows, or more numbers taken, than this are numbered by ranges instead of one window a name.
MOST_EQUAL = 100_000


def free_destinations(rows: DataFrame, src: str, folder: str, taken: DataFrame | None = None) -> DataFrame:
    """rows with dest_path: their names in one folder, the second and later of equal names by path as name_1, name_2 ...
    taken: name, of files that are there already, which the first of a name gives way to as well. Numbers whose name is
    taken, or is another row's own name, are left out: the j-th row of a name gets the j-th number that is free. Names
    made for different names never meet, so one pass over each name's rows and taken numbers is exact. A name may have
    any share of the rows, see MOST_EQUAL."""
    name = F.element_at(F.split(src, "/"), -1)
    split = lambda c: (F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(c, r"(?<=.)(\.[^.]*)$", 1))
    out = rows.withColumn("_name", name)
    known = out.select("_name")
    out, there = out.withColumn("_old", F.lit(0)), None
    if taken is not None:
        there = taken.select(F.col("name").alias("_name")).distinct()
        known = known.unionByName(there)
        out = out.drop("_old").join(there.withColumn("_old", F.lit(1)), "_name", "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
    stem, ext = split(F.col("_name"))
    number = r"(?s)^(.+)_([1-9][0-9]*)$"
    used = known.distinct().select(F.concat(F.regexp_extract(stem, number, 1), ext).alias("_name"), F.regexp_extract(stem, number, 2).try_cast("long").alias("_k")).where("_k is not null")
    most = out.select("_name").unionByName(used.select("_name")).groupBy("_name").count().agg(F.max("count")).first()[0] or 0
    if most <= MOST_EQUAL:
        at = lambda df, by: df.withColumn("_i", F.row_number().over(W.partitionBy("_name").orderBy(by)).cast("long") - 1)
    else:
        at = lambda df, by: numbered(df, ["_name"], [by], "_i")
    out = at(out, src).withColumn("_at", F.col("_i") + F.col("_old")).withColumn("_mark", F.lit(0))
    used = at(used, "_k").select("_name", (F.col("_k") - F.col("_i") - 1).alias("_at"), F.lit(1).alias("_mark"))
    both = out.drop("_i").unionByName(used, allowMissingColumns=True)
    if most <= MOST_EQUAL:
        passed = F.sum("_mark").over(W.partitionBy("_name").orderBy("_at", "_mark").rowsBetween(W.unboundedPreceding, 0))
        both = both.withColumn("_passed", passed)
    else:  # a row's place among rows and marks, less the rows in front of it
        both = numbered(both, ["_name"], ["_at", "_mark"], "_i").withColumn("_passed", F.col("_i") - F.col("_at") + F.col("_old")).drop("_i")
    done = both.where("_mark = 0")
    made = F.when(F.col("_at") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), (F.col("_at") + F.col("_passed")).cast("string"), ext))
    return done.withColumn("dest_path", F.concat(F.lit(folder.rstrip("/") + "/"), made)).drop("_name", "_at", "_mark", "_passed", "_old")


def trash_plan(rows: DataFrame, op: str, src: str, prefix: str, stamp: str, reason: str, taken: DataFrame | None = None) -> DataFrame:
    """Moves into .trash/{prefix}_{stamp}, numbered on collision."""
    return plan(free_destinations(rows, src, f".trash/{prefix}_{stamp}", taken), op, "MOVE", src, dest_path="dest_path", reason=F.lit(reason))


def archive_plan(rows: DataFrame, src: str, root: str, archive: str) -> DataFrame:
    """Moves from root to archive that keep the folders below."""
    dest = F.concat(F.lit(archive.rstrip("/") + "/"), F.regexp_replace(src, "^" + root.rstrip("/").replace(".", r"\.") + "/", ""))
    return plan(rows, "archive", "MOVE", src, dest_path=dest, reason=F.lit("archived by report"))


def apply(rows: DataFrame, vault: str, confirm: bool = False) -> list[tuple[str, str]]:
    """Does what a plan says, below the folder `vault` of this machine, row by row; (src_path, status) of each. Nothing
    happens without confirm. Rows are streamed; plans are meant to be looked at first."""
    if not confirm:
        raise ValueError("apply() changes files: pass confirm=True")
    root, out = Path(vault).resolve(), []
    for r in rows.toLocalIterator():
        src = root / r["src_path"]
        dest = root / r["dest_path"] if r["dest_path"] else None
        if any(not p.resolve().is_relative_to(root) for p in (src, dest) if p):
            status = "OUTSIDE"
        elif r["action"] == "REWRITE" and r["new_content"] is not None and src.is_file():
            src.write_text(r["new_content"], encoding="utf-8")
            status = "DONE"
        elif not src.exists():
            status = "MISSING"
        elif src.is_dir():
            status = "SKIP_DIR"
        elif r["action"] in ("MOVE", "COPY") and dest:
            dest.parent.mkdir(parents=True, exist_ok=True)
            status = "EXISTS" if dest.exists() else "DONE"
            if status == "DONE":
                (shutil.move if r["action"] == "MOVE" else shutil.copy2)(src, dest)
        elif r["action"] == "DELETE":
            src.unlink()
            status = "DONE"
        else:
            status = "UNKNOWN"
        out.append((r["src_path"], status))
    return out
