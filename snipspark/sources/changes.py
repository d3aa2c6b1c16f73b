"""A stream of changes to a folder: files that were added, changed and removed since the last batch.

Spark's own stream of files sees new names only. Here an offset is a snapshot of the folder's listing (path, size, mtime), kept as a file under a state folder that
all machines share; a batch compares two snapshots, a part of the paths in each task, so contents are never read to find a change."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import IGNORED, Rules, listed, opened

CHANGES = "path string, change string, size long, mtime_ms long"
LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.int64()), ("part", pa.int32())])
#: Paths of a listing that are written at once; parts that a comparison is dealt to.
ROWS, PARTS = 50_000, 16
NONE = ""


class ChangesSource(DataSource):
    """Options: path (the folder), state (a folder for snapshots), parts."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesReader(self.options["path"], self.options["state"], int(self.options.get("parts", PARTS)))


class Part(InputPartition):
    def __init__(self, start: str, end: str, part: int):
        super().__init__(part)
        self.start, self.end, self.part = start, end, part


class ChangesReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, parts: int):
        self.root, self.state, self.parts = root, state, parts

    def initialOffset(self) -> dict:
        return {"snapshot": NONE}

    def latestOffset(self) -> dict:
        """A new snapshot, or the one that is there already if nothing changed: its name is a digest of the listing. A folder at a time is in memory,
        and as many rows as are written at once; each snapshot is in the order of its walk."""
        system, base = opened(self.root)
        store, folder = opened(self.state)
        store.create_dir(folder, recursive=True)
        rules, stack, digest, rows = Rules(IGNORED), [""], hashlib.sha256(), []
        staged = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as sink, pq.ParquetWriter(sink, LISTED) as out:

            def flush():
                # each row group holds one part, so a task reads its own
                for p in range(self.parts):
                    own = [r for r in rows if r[3] == p]
                    if own:
                        out.write_table(pa.table(list(map(list, zip(*own))), schema=LISTED))
                rows.clear()

            while stack:
                folders, found = listed(system, base, stack.pop(), rules)
                stack += sorted(folders, reverse=True)
                for path, size, mtime in sorted(found):
                    digest.update(json.dumps([path, size, mtime]).encode())
                    rows.append((path, size, mtime, zlib.crc32(path.encode()) % self.parts))
                    if len(rows) >= ROWS:
                        flush()
            flush()
        name = digest.hexdigest()
        store.move(staged, f"{folder}/{name}.parquet")
        return {"snapshot": name}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [] if start == end else [Part(start["snapshot"], end["snapshot"], p) for p in range(self.parts)]

    def _snapshot(self, name: str, part: int) -> dict:
        if name == NONE:
            return {}
        store, folder = opened(self.state)
        rows = pq.read_table(f"{folder}/{name}.parquet", filesystem=store, filters=[("part", "=", part)])
        return dict(zip(rows["path"].to_pylist(), zip(rows["size"].to_pylist(), rows["mtime_ms"].to_pylist())))

    def read(self, partition: Part) -> Iterator[tuple]:
        old, new = self._snapshot(partition.start, partition.part), self._snapshot(partition.end, partition.part)
        for path, facts in new.items():
            if old.get(path) != facts:
                yield path, "changed" if path in old else "added", *facts
        for path in old.keys() - new.keys():
            yield path, "removed", None, None

    def commit(self, end: dict) -> None:
        """Snapshots stay: a restart may begin at the last one that was committed."""


def change_stream(spark, root: str, state: str, parts: int = PARTS):
    """(CHANGES) of a folder as a stream. The first batch has all files as added."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format("folder_changes").option("path", root).option("state", state).option("parts", parts).load()
