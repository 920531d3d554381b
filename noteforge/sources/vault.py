"""A data source for folders of notes. It sees what Spark's file sources hide: names with a leading dot or underscore,
empty files, names with # and %.

    spark.dataSource.register(VaultSource)
    spark.read.format("vault").option("policy", "shared").load("/vault")                       # metadata and md5
    spark.read.format("vault").option("relation", "contents").option("suffix", ".md").load("/vault")

    spark.read.format("vault").option("subfolder", "INBOX").option("policy", "strict").load("/vault")
    spark.readStream.format("vault").option("relation", "contents").load("/vault")            # new and changed files

The folder must be visible to the executors under the same path. Files are listed on the driver, folder by folder, and
read in chunks of CHUNK_BYTES by the tasks.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK_BYTES, CHUNK_FILES = 64 << 20, 5000
FILES = "rel_path string, name string, stem string, ext string, size long, mtime timestamp, md5 string"
CONTENTS = "rel_path string, content binary"


def hidden(rel_path: str, policy: str, trash: bool = False, obsidian: bool = False) -> bool:
    """Whether a vault-relative path is left out; see functions.text.is_hidden. shared: opt-ins for .trash and .obsidian;
    strict: whatever has a part with a leading dot. The folder of the plan sink is never a vault's file."""
    parts = rel_path.split("/")
    if parts[0] == ".noteforge":
        return True
    own = any(p in (".trash", ".obsidian") for p in parts)
    if policy == "none":
        return False
    if policy == "fallback":
        return own
    if policy == "inverted":
        return not own and any(p.startswith(".") for p in parts)
    allowed = {n for n, wanted in ((".trash", trash), (".obsidian", obsidian)) if wanted and policy == "shared"}
    return any(p.startswith(".") and p not in allowed for p in parts)


class Chunk(InputPartition):
    """Files of one task: (path, size, change in ns) each; the change is none where any state of the file will do."""

    def __init__(self, files: list[tuple[str, int, int | None]]):
        super().__init__(0)
        self.files = files


class Vault:
    """What both readers share: the options, the listing, chunks and rows."""

    def __init__(self, options: dict[str, str]):
        self.root, self.subfolder = options["path"].removeprefix("file://"), options.get("subfolder", "")
        self.policy, self.relation = options.get("policy", "shared"), options.get("relation", "files")
        self.suffix, self.digest = options.get("suffix", ""), options.get("md5", "true") == "true"
        self.trash, self.obsidian = options.get("trash") == "true", options.get("obsidian") == "true"
        self.clock = options.get("clock", "mtime")

    def changed(self, info: os.stat_result) -> int:
        return max(info.st_mtime_ns, info.st_ctime_ns) if self.clock == "change" else info.st_mtime_ns

    def listed(self) -> Iterator[tuple[str, int, int]]:
        """Path, size and change of every file that the options let in; files that go meanwhile are left out."""
        for folder, folders, names in os.walk(os.path.join(self.root, self.subfolder)):
            folders.sort()
            for name in sorted(names):
                rel = os.path.relpath(os.path.join(folder, name), self.root).replace(os.sep, "/")
                if name.endswith(self.suffix) and not hidden(rel, self.policy, self.trash, self.obsidian):
                    try:
                        info = os.stat(os.path.join(folder, name))
                    except FileNotFoundError:
                        continue
                    yield rel, info.st_size, self.changed(info)

    def chunks(self, files: Iterator[tuple[str, int, int | None]]) -> list[Chunk]:
        chunks: list[Chunk] = []
        held: list[tuple[str, int, int | None]] = []
        size = 0
        for file in files:
            held.append(file)
            size += file[1]
            if size >= CHUNK_BYTES or len(held) >= CHUNK_FILES:
                chunks.append(Chunk(held))
                held, size = [], 0
        return [*chunks, Chunk(held)] if held or not chunks else chunks

    def rows(self, chunk: Chunk) -> Iterator[tuple]:
        for rel, _, changed in chunk.files:
            path = os.path.join(self.root, rel)
            if changed is None:
                yield self.row(rel, path)
                continue
            try:
                row = self.row(rel, path) if self.changed(os.stat(path)) == changed else None
                same = row and self.changed(os.stat(path)) == changed
            except FileNotFoundError:
                continue
            if same:
                yield row

    def row(self, rel: str, path: str) -> tuple:
        if self.relation == "contents":
            with open(path, "rb") as f:
                return rel, f.read()
        digest = None
        if self.digest:
            h = hashlib.md5(usedforsecurity=False)
            with open(path, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            digest = h.hexdigest()
        name = rel.rsplit("/", 1)[-1]
        stem, ext = os.path.splitext(name)
        info = os.stat(path)
        return rel, name, stem, ext, info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc), digest


class VaultReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.vault = Vault(options)

    def partitions(self) -> list[Chunk]:
        return self.vault.chunks((rel, size, None) for rel, size, _ in self.vault.listed())

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return self.vault.rows(partition)


class VaultStreamReader(DataSourceStreamReader):
    """New and changed files, each state of a file once. An offset is the (change, path) of the last file of a batch in
    that order, and a batch holds what lies between two offsets, so a batch that is run again after a failure plans the
    same files. A file that has changed since its batch was planned is left to the batch that its new state belongs to;
    one that is gone gives no row. Files younger than `settle_ms` (default 1000) wait, so that no file can get a time that
    was passed already; should the newest files vanish, the offset falls back to what is left, which was all read.

    clock: `mtime` (default) or `change`, the later of mtime and ctime, which also sees files that are moved in with an
    old mtime, and reads files again whose attributes alone change."""

    def __init__(self, options: dict[str, str]):
        self.vault = Vault(options)
        self.settle = int(options.get("settle_ms", "1000")) * 1_000_000

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - self.settle
        changed, path = max(((c, rel) for rel, _, c in self.vault.listed() if c <= until), default=(-1, ""))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        first, last = ((o["changed"], o["path"]) for o in (start, end))
        files = sorted((c, rel, size) for rel, size, c in self.vault.listed() if first < (c, rel) <= last)
        return self.vault.chunks((rel, size, c) for c, rel, size in files)

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return self.vault.rows(partition)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return CONTENTS if self.options.get("relation") == "contents" else FILES

    def reader(self, schema) -> VaultReader:
        return VaultReader(dict(self.options))

    def streamReader(self, schema) -> VaultStreamReader:
        return VaultStreamReader(dict(self.options))
