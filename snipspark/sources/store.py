"""A versioned store of Parquet tables in buckets: a commit writes new folders for the buckets it touches and then moves one
pointer, so a reader sees whole commits only, nothing is overwritten while it is read, and what a commit writes grows with
the change.

Rows of a table are dealt to buckets by a hash of its key. The pointer of a version, a small file, names the folders of each table's buckets. It
is written under another name and renamed, which fails if that version exists: of two writers one gets `Conflict` and may
try again. A writer that dies before the rename leaves folders that no pointer names; `vacuum` removes them. The file system must rename
files atomically, as HDFS and local ones do."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table schemas; never inferred.
SCHEMAS = {
    "files": "path string, hash string, size long, language string, mtime_ms long, indexed_at_ms long",
    "symbols": "id string, name string, kind string, file_path string, start_line int, end_line int, start_column int, end_column int, signature string, documentation string, parent_id string, language string, exported boolean",
    "imports": "id string, file_path string, source string, imported_names array<string>, is_default boolean, line int",
    "refs": "id string, from_symbol_id string, to_name string, kind string, file_path string, line int",
    "chunks": "id string, symbol_id string, file_path string, content string, hash string, language string, ord long, symbol_name string, symbol_kind string, signature string, parent_id string, start_line int, end_line int",
    "nodes": "id string, kind string, name string, file_path string, symbol_kind string",
    "edges": "from_id string, to_id string, kind string, file_path string",
    "terms": "chunk_id string, file_path string, language string, symbol_kind string, symbol_name string, ts array<string>, dl int",
    "vectors": "chunk_id string, file_path string, vector array<double>, provider string",
    "links": "ref_id string, symbol_id string, file_path string",
    "memory": "category string, key string, content string, created_at long, updated_at long",
    "log": "kind string, tokens long, saved long, latency_ms long, hit boolean",
}
#: What rows are dealt to buckets by; tables without a key have one bucket and are appended to.
KEYS = {name: "file_path" for name, s in SCHEMAS.items() if "file_path" in s} | {"files": "path", "memory": "key"}
#: Buckets of a keyed table; folders of a bucket beyond which an append writes the bucket anew.
BUCKETS, PARTS = 64, 32
#: Tables that a commit writes at once.
TABLES = 4


class Conflict(Exception):
    """Another writer committed this version first."""


class Store:
    """Snapshots under one folder of a file system that Spark writes to. The number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] = SCHEMAS, keys: dict[str, str] = KEYS, buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.keys, self.wanted = spark, root.rstrip("/"), schemas, keys, buckets

    # the file system
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    # versions
    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": number, "tables": {table: {bucket: [folders]}}} of a version, of the last one by default."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return {"buckets": self.wanted, "tables": {}}
        stream = self._fs().open(self._path("commits", str(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, version: int, manifest: dict) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        staged, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", str(version))
        out = fs.create(staged, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(kind, 1)
        modes[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(final), modes)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise

    # reading
    def place(self, name: str, buckets: int) -> Column:
        """The bucket of a row."""
        key = self.keys.get(name)
        return F.lit(0) if key is None else F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets, as of the last commit or a version; empty if it was never written."""
        held = self.manifest(version)["tables"].get(name, {})
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for b, folders in held.items() if buckets is None or int(b) in buckets for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def fields(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name]).columns

    # writing
    def _written(self, name: str, rows: DataFrame, buckets: int) -> dict[str, list[str]]:
        """The rows in a new folder, by bucket."""
        folder = uuid.uuid4().hex
        # large buckets become several files, small ones one
        rows.select(*self.fields(name)).withColumn("bucket", self.place(name, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        return {n.removeprefix("bucket="): [folder] for n in self._names(name, folder) if n.startswith("bucket=")}

    def commit(self, whole: dict[str, DataFrame] | None = None, replaced: dict[str, tuple[DataFrame, DataFrame]] | None = None, appended: dict[str, DataFrame] | None = None) -> int:
        """One version: `whole` tables are written anew; of `replaced` ones (new rows, keys that go) the buckets of the keys are, in which
        none of the old rows with such a key stays; rows of `appended` ones are added. Other tables and buckets stay as they are. The
        keys of new rows must be among those that go, as must be a null that stands for the rows without a key."""
        base = (self.versions() or [0])[-1]
        known = self.manifest(base)
        buckets, held = known["buckets"], known["tables"]
        writes, touched = dict(whole or {}), {}
        places: dict[tuple, list[int]] = {}
        for name, (rows, gone) in (replaced or {}).items():
            key = self.keys[name]
            keys = gone if key in gone.columns else gone.withColumnRenamed(gone.columns[0], key)
            place = self.place(name, buckets).alias("b")
            # at most one for each bucket; tables that are changed alike ask once
            at = (id(gone), str(place).replace(key, ""))
            if at not in places:
                places[at] = sorted(r.b for r in keys.select(place).distinct().collect())
            touched[name] = places[at]
            named = keys.select(F.col(key).alias("__gone")).distinct()
            kept = self.table(name, touched[name], base).join(named, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
            writes[name] = kept.select(*self.fields(name)).unionByName(rows.select(*self.fields(name)))
        added = set()
        for name, rows in (appended or {}).items():
            whole_again = max(map(len, held.get(name, {"": []}).values())) >= PARTS
            writes[name] = self.table(name, version=base).unionByName(rows.select(*self.fields(name))) if whole_again else rows
            added |= set() if whole_again else {name}
        with ThreadPoolExecutor(TABLES) as pool:  # tables are written beside each other
            written = dict(zip(writes, pool.map(lambda n: self._written(n, writes[n], buckets), writes)))
        for name, new in written.items():
            if name in added:
                for b, folders in new.items():
                    held.setdefault(name, {}).setdefault(b, []).extend(folders)
            else:
                held[name] = {b: f for b, f in held.get(name, {}).items() if name in touched and int(b) not in touched[name]} | new
        self._point(base + 1, known)
        return base + 1

    def vacuum(self, keep: int = 1) -> int:
        """Removes what none of the last versions names, and older pointers; the number of folders removed. Not beside a
        writer: what it has written isn't named yet."""
        fs, held = self._fs(), self.versions()
        named = {(t, f) for v in held[-keep:] for t, bs in self.manifest(v)["tables"].items() for fs_ in bs.values() for f in fs_}
        removed = 0
        for name in self.schemas:
            for folder in self._names(name):
                if (name, folder) not in named:
                    fs.delete(self._path(name, folder), True)
                    removed += 1
        for n in self._names("commits"):
            if not n.isdigit() or int(n) not in held[-keep:]:
                fs.delete(self._path("commits", n), False)
        return removed
