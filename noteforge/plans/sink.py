"""Plans carried out by executors, in two phases: prepared aside and committed by one marker, then published in tasks.

    run(plan_rows, "/vault", confirm=True)      # src_path, action, dest_path, status of each row
    recover(spark, "/vault")                    # after a crash: finishes what was committed, removes what wasn't

Writing a plan (format `vault_plan`) changes nothing in the vault: each task checks its rows, writes new contents and
copies to a folder of its own below `.noteforge/<run>`, and a journal of what is to be done. A task that fails removes its
folder. The commit is one file that names the journals, put in place by a rename; an aborted run is removed whole. What
is committed is published by a Spark job over the journals, whose steps are renames and can be repeated: a file is only
taken for done if it is the very file that the journal names. The vault lies under one path for driver and executors.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from noteforge.plans.plan import COLUMNS
from noteforge.session import ship_package

STAGING = ".noteforge"
JOURNAL = "action string, src_path string, dest_path string, staged string, inode long, status string"


def inside(root: Path, path: str | None) -> Path | None:
    """The file that a plan's path names, none where it lies outside the vault or in the sink's own folder."""
    p = (root / path).resolve() if path else root
    return p if p.is_relative_to(root) and p != root and STAGING not in p.relative_to(root).parts[:1] else None


def prepared(root: Path, row, folder: Path, number: int) -> dict:
    """The journal's entry of a plan's row: a status if there is nothing to do, else TODO and what publish() needs."""
    action, src_path, dest_path, content = row["action"], row["src_path"], row["dest_path"], row["new_content"]
    entry = {"action": action, "src_path": src_path, "dest_path": dest_path, "staged": None, "inode": None}
    src, dest = inside(root, src_path), inside(root, dest_path) if dest_path else None
    if src is None or dest_path and dest is None:
        return entry | {"status": "OUTSIDE"}
    if not src.exists():
        return entry | {"status": "MISSING"}
    if src.is_dir():
        return entry | {"status": "SKIP_DIR"}
    if action in ("MOVE", "COPY") and dest and dest.exists():
        return entry | {"status": "EXISTS"}
    staged = folder / str(number)
    if action == "REWRITE" and content is not None:
        staged.write_text(content, encoding="utf-8", newline="")
        shutil.copymode(src, staged)
    elif action == "COPY" and dest:
        shutil.copy2(src, staged)
    elif not (action == "MOVE" and dest or action == "DELETE"):
        return entry | {"status": "UNKNOWN"}
    made = action in ("REWRITE", "COPY")
    return entry | {"status": "TODO", "staged": str(staged.relative_to(root)) if made else None, "inode": (staged if made else src).stat().st_ino}


def published(root: Path, e: dict) -> str:
    """Does what a journal's entry says and returns the status. Repeated, it finds its own result and says the same."""
    src = root / e["src_path"]
    if e["action"] == "REWRITE":
        staged = root / e["staged"]
        if staged.exists():
            os.replace(staged, src)
        return "DONE"
    if e["action"] == "DELETE":
        if src.exists() and src.stat().st_ino == e["inode"]:
            src.unlink()
        return "DONE"
    origin, dest = (root / e["staged"] if e["staged"] else src), root / e["dest_path"]
    dest.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.link(origin, dest)  # fails where the name is taken, so no file is lost
    except FileExistsError:
        if dest.stat().st_ino != e["inode"]:
            return "EXISTS"
    except FileNotFoundError:
        return "DONE" if dest.exists() and dest.stat().st_ino == e["inode"] else "MISSING"
    origin.unlink(missing_ok=True)
    return "DONE"


@dataclass
class Prepared(WriterCommitMessage):
    folder: str
    rows: int


class PlanWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        if options.get("confirm") != "true":
            raise ValueError("a plan changes files: set the option confirm to true")
        self.root = Path(options["path"].removeprefix("file://")).resolve()
        self.run = self.root / STAGING / options.get("run", uuid.uuid4().hex)
        self.run.mkdir(parents=True)  # by the driver alone: a task that outlives an abort finds no folder to write to

    def write(self, iterator: Iterator) -> Prepared:
        task = TaskContext.get()
        folder = self.run / f"part-{task.partitionId()}-{task.taskAttemptId()}"
        folder.mkdir()
        n = 0
        try:
            with open(folder / "journal.json", "w", encoding="utf-8") as journal:
                for n, row in enumerate(iterator, 1):
                    journal.write(json.dumps(prepared(self.root, row, folder, n)) + "\n")
                journal.flush()
                os.fsync(journal.fileno())
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Prepared(folder.name, n)

    def commit(self, messages: list[Prepared | None]) -> None:
        """Names the journals of the attempts that count; one entry for each task, none for each row."""
        counted = {m.folder: m.rows for m in messages if m}
        for left in self.run.glob("part-*"):
            if left.name not in counted:
                shutil.rmtree(left, ignore_errors=True)
        (self.run / "committing").write_text(json.dumps(counted))
        os.replace(self.run / "committing", self.run / "committed.json")

    def abort(self, messages: list[Prepared | None]) -> None:
        gone = self.run.with_name(f"aborted-{self.run.name}")
        os.replace(self.run, gone)
        shutil.rmtree(gone)
        if self.run.parent.is_dir() and not os.listdir(self.run.parent):
            self.run.parent.rmdir()


class PlanSink(DataSource):
    """Options: path (the vault), confirm (true), run (a name for the run)."""

    @classmethod
    def name(cls) -> str:
        return "vault_plan"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def writer(self, schema, overwrite: bool) -> PlanWriter:
        return PlanWriter(dict(self.options))


def prepare(rows: DataFrame, vault: str, confirm: bool = False) -> str:
    """The first phase; the run's name."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    ship_package(spark)
    spark.dataSource.register(PlanSink)
    rows.select(*COLUMNS).write.format("vault_plan").options(path=vault, confirm=str(confirm).lower(), run=run).mode("append").save()
    return run


def publish(spark: SparkSession, vault: str, run: str) -> DataFrame:
    """The second phase, by tasks over the journals of a committed run; src_path, action, dest_path, status of each row,
    kept as JSON in the run's folder."""
    ship_package(spark)
    root = Path(vault.removeprefix("file://")).resolve()
    folder = root / STAGING / run
    result, done = str(folder / "result"), folder / "done.json"
    if not done.exists():
        journals = [f"file://{folder}/{name}/journal.json" for name in json.loads((folder / "committed.json").read_text())]

        def carry_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                entries = batch.astype(object).where(batch.notna(), None).to_dict("records")
                batch["status"] = [published(root, e) if e["status"] == "TODO" else e["status"] for e in entries]
                yield batch[["src_path", "action", "dest_path", "status"]]

        entries = spark.read.schema(JOURNAL).json(journals) if journals else spark.createDataFrame([], JOURNAL)
        entries.mapInPandas(carry_out, "src_path string, action string, dest_path string, status string").write.mode("overwrite").json(f"file://{result}")
        os.replace(folder / "committed.json", done)
        for part in folder.glob("part-*"):
            shutil.rmtree(part)
    return spark.read.schema("src_path string, action string, dest_path string, status string").json(f"file://{result}")


def run(rows: DataFrame, vault: str, confirm: bool = False) -> DataFrame:
    """Carries out a plan; src_path, action, dest_path, status of each row: DONE, MISSING, EXISTS, SKIP_DIR, OUTSIDE or
    UNKNOWN. Of rows that want the same new name one gets it. Without confirm nothing happens but an error."""
    return publish(rows.sparkSession, vault, prepare(rows, vault, confirm))


def recover(spark: SparkSession, vault: str) -> dict[str, str]:
    """Brings every run of the vault to its end: committed ones are published, others removed; what became of each."""
    out, staging = {}, Path(vault.removeprefix("file://")).resolve() / STAGING
    for folder in sorted(staging.iterdir()) if staging.is_dir() else []:
        if (folder / "committed.json").exists():
            publish(spark, vault, folder.name)
            out[folder.name] = "PUBLISHED"
        elif not (folder / "done.json").exists():
            shutil.rmtree(folder)
            out[folder.name] = "REMOVED"
    return out
