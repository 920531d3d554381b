"""Files by time against a plain layout, written twice."""

import hashlib
import os
import random
from datetime import datetime, timedelta
from zlib import crc32

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from noteforge.llm import time_layout

DDL = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, leaf int, Part string, _moment double"
LATE = datetime(2024, 3, 1)


def plain(rows, limit):
    """{(leaf, part): rows} of (moment, row) pairs: every calendar node is looked at one by one."""
    out = {}

    def put(text, held):
        held = sorted(held, key=lambda x: (x[0] or datetime.min, x[1]["arrived_at"] or datetime.min, -1 if x[1]["click_id"] is None else x[1]["click_id"]))
        for i in range(0, len(held), limit):
            out[text, i // limit + 1] = [r for _, r in held[i : i + limit]]

    def inside(rows, names, level, parents):
        """names: the siblings in time order; a row's own is level(moment)."""
        run = []
        for name in [*names, None]:
            held = [r for r in rows if level(r[0]) == name] if name is not None else []
            deep = len(parents)
            if run and (name is None or len(run[-1][1]) + len(held) > limit or len(held) > limit):
                if run[-1][1]:
                    put("/".join([*parents, f"{run[0][0]}-{run[-1][0]}"]), run[-1][1])
                run = []
            if name is None:
                continue
            if len(held) > limit and deep < 3:
                if deep == 0:
                    inside(held, [f"{m:02d}" for m in range(1, 13)], lambda t: f"{t.month:02d}", [*parents, name])
                elif deep == 1:
                    first = datetime(int(parents[0]), int(name), 1)
                    days = [d for d in (first + timedelta(i) for i in range(31)) if d.month == first.month]
                    inside(held, [f"{d.day:02d}" for d in days], lambda t: f"{t.day:02d}", [*parents, name])
                else:
                    inside(held, [f"{x:02d}" for x in range(24)], lambda t: f"{t.hour:02d}", [*parents, name])
            else:
                run = [(run[0][0] if run else name, (run[-1][1] if run else []) + held), (name, (run[-1][1] if run else []) + held)]

    known = [r for r in rows if r[0] is not None]
    if known:
        years = [r[0].year for r in known]
        inside(known, [f"{y:04d}" for y in range(min(years), max(years) + 1)], lambda t: f"{t.year:04d}", [])
    put("null", [r for r in rows if r[0] is None])
    return out


def moment(r):
    if r["ts"] is None or r["click_id"] is None:
        return r["ts"]
    k = crc32(str(r["click_id"]).encode()) % 128
    if k < 16:
        return r["ts"] - timedelta((k + 6) ** 3)
    return datetime(r["ts"].year, r["ts"].month, r["ts"].day) - timedelta(r["ts"].weekday()) if k > 111 else r["ts"]


def ids(rows):
    return ["" if r["click_id"] is None else str(r["click_id"]) for r in rows]


def check(got, rows, limit, folder, columns):
    """got: collected files; rows: dicts."""
    dated = [(moment(r), r) for r in rows]
    old = plain([x for x in dated if x[1]["arrived_at"] is not None and x[1]["arrived_at"] < LATE], limit)
    new = plain(dated, limit)
    key = lambda r: tuple(map(repr, r.values()))
    assert {(r["leaf"], r["part"]) for r in got} == set(new) and len(got) == len(new)
    for r in got:
        want = new[r["leaf"], r["part"]]
        assert r["n_rows"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(ids(want)).encode()).hexdigest()
        late = [x for x in want if x["arrived_at"] is None or x["arrived_at"] >= LATE]
        assert r["n_new"] == len(late)
        assert r["rewritten"] == (sorted(map(key, old.get((r["leaf"], r["part"]), []))) != sorted(map(key, want)))
        table = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert table.column_names == columns
        held = table.to_pylist()
        assert ids(held) == ids(want) and sorted(map(key, held)) == sorted(map(key, want))
    there = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    assert there == {"/" + r["path"].removeprefix("file:").lstrip("/") for r in got}


def clicks(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(120 * 86400)) if rng.random() < 0.6 else datetime(2024, 2, 29, 7, rng.randrange(60))
        ts = None if rng.random() < 0.06 else ts
        out.append((i if rng.random() < 0.98 else None, ts, (ts or datetime(2024, 2, 1)) + timedelta(hours=rng.choice([0, 0, 0, 500])) if rng.random() < 0.97 else None, rng.choice(["view", None]), rng.choice([1, None]), "p", 0.5))
    return out + rng.sample(out, n // 10) + [out[3]] * (n // 6)


def run(spark, rows, limit, folder):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    late = F.col("arrived_at") >= F.lit(str(LATE)).cast("timestamp_ntz")
    return df, time_layout.time_partitions(df, time_layout.click_moment(), ["arrived_at", "click_id"], late, limit, folder, "click_id")


def test_layout_and_rewrite(spark, tmp_path):
    """An hour of two fifths of the rows, one row a sixth of them, nulls, repeated rows, clashing columns."""
    df, out = run(spark, clicks(600, 1), 40, f"file://{tmp_path}/a")
    got = [r.asDict() for r in out.collect()]
    check(got, [r.asDict() for r in df.collect()], 40, f"{tmp_path}/a", df.columns)
    assert any(r["part"] > 2 for r in got) and {r["rewritten"] for r in got} == {True, False}


def test_parts_before_the_first_new_row_stay(spark, tmp_path):
    """One hour in several parts: late rows at its end leave the first parts alone."""
    rows = [(i + 1000, datetime(2024, 1, 1, 5, i // 60, i % 60), datetime(2024, 1, 2) if i < 25 else datetime(2024, 3, 2), "v", 1, "p", 0.5) for i in range(35)]
    rows = [r for r in rows if 16 <= crc32(str(r[0]).encode()) % 128 <= 111]
    df, out = run(spark, rows, 5, f"file://{tmp_path}/a")
    got = [r.asDict() for r in out.collect()]
    check(got, [r.asDict() for r in df.collect()], 5, f"{tmp_path}/a", df.columns)
    assert {r["leaf"] for r in got} == {"2024/01/01/05-05"}
    assert [r["rewritten"] for r in sorted(got, key=lambda r: r["part"])][:2] == [False, False] and got[-1]["part"] > 3


def test_one_leaf_nulls_only_and_none(spark, tmp_path):
    day = datetime(2024, 1, 1)
    for i, rows in enumerate(([(5, day, day, "v", 1, "p", 0.5)], [(5, None, day, None, None, None, None)] * 7, [(5, day, None, "v", 1, "p", 0.5)], [])):
        df, out = run(spark, rows, 3, f"file://{tmp_path}/{i}")
        check([r.asDict() for r in out.collect()], [r.asDict() for r in df.collect()], 3, f"{tmp_path}/{i}", df.columns)


def test_calendar_keeps_empty_siblings_and_order():
    def counts(**levels):
        return [{k: [v] for k, v in levels.get(n, {}).items()} for n in time_layout.LEVELS]

    y, m = 2024, 2024 * 12
    leaves = time_layout.calendar(counts(year={2020: 2, 2024: 9, 2025: 1, 2026: 3}, month={m: 3, m + 1: 2, m + 11: 4}), 4, 0)
    assert [(x.text, x.rows) for x in leaves] == [("2020-2023", 2), ("2024/01-01", 3), ("2024/02-11", 2), ("2024/12-12", 4), ("2025-2026", 4)]
    day = 19723
    hours = time_layout.calendar(counts(year={y: 9}, month={m: 9}, day={day: 9}, hour={day * 24 + 3: 9}), 4, 0, 2)
    assert [(x.text, x.rows) for x in hours] == [("2024/01/01/03-03", 9), ("null", 2)] and hours[0].parts(4) == [4, 4, 1]


def test_query(spark, sf):
    got = [r.asDict() for r in time_layout.op12_time_partitions(spark, sf).collect()]
    table = spark.read.parquet(f"{sf}/clicks.parquet")
    folder = got[0]["path"].removeprefix("file:").split("/leaf=")[0]
    check(got, [r.asDict() for r in table.collect()], 1 + table.count() // 650, "/" + folder.lstrip("/"), table.columns)
    assert {r["columns"] for r in got} == {",".join(table.columns)}
