"""The store: whole commits or none, buckets, writers that die or meet; the engine's changes against an index from nothing."""

import os

import pytest
from pyspark.sql import functions as F

from snipspark.plans.engine import Engine
from snipspark.sources.store import Conflict, Store

SCHEMAS = {"docs": "path string, n int", "log": "n int"}


def docs(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMAS["docs"])


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), SCHEMAS, {"docs": "path"}, buckets=8)
    s.commit(whole={"docs": docs(spark, [(f"p{i}", 0) for i in range(200)])})
    return s


def held(store, **where):
    return sorted(map(tuple, store.table("docs", **where).collect()), key=str)


def test_replace_writes_touched_buckets_only(store, spark):
    before = store.manifest()["tables"]["docs"]
    store.commit(replaced={"docs": (docs(spark, [("p3", 1), ("new", 1), (None, 5)]), spark.createDataFrame([("p3",), ("p7",), ("new",), (None,)], "path string"))})
    after = store.manifest()["tables"]["docs"]
    same = [b for b in before if after.get(b) == before[b]]
    assert 4 <= len(same) < 8
    want = {f"p{i}": 0 for i in range(200) if i not in (3, 7)} | {"p3": 1, "new": 1, None: 5}
    assert dict(held(store)) == want
    assert dict(held(store, version=1)) == {f"p{i}": 0 for i in range(200)}


def test_all_rows_of_a_bucket_may_go(store, spark):
    store.commit(replaced={"docs": (docs(spark, []), store.table("docs").select("path"))})
    assert held(store) == [] and store.versions() == [1, 2]


def test_a_commit_that_dies_is_not_seen_and_blocks_nothing(store, spark, monkeypatch):
    # before its first table, within its tables, and before and within the pointer
    broken = docs(spark, [("x", 1)]).withColumn("n", F.raise_error(F.lit("dies")).cast("int"))
    with pytest.raises(Exception, match="dies"):
        store.commit(whole={"docs": broken})
    with pytest.raises(Exception, match="dies"):
        store.commit(whole={"docs": docs(spark, [("y", 1)]), "log": broken.select("n")})
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.commit(whole={"docs": docs(spark, [("z", 1)])})
    folder = os.path.join(store.root, "commits")
    with open(os.path.join(folder, ".half"), "w") as f:
        f.write('{"buckets": 8, "tab')
    assert len(held(store)) == 200 and store.versions() == [1]
    store.commit(appended={"log": spark.createDataFrame([(1,)], "n int")})
    assert len(held(store)) == 200 and store.table("log").count() == 1
    # what the dead ones left goes
    assert store.vacuum() >= 2
    assert len(held(store)) == 200 and store.table("log").count() == 1 and store.versions() == [2]


def test_of_two_writers_one_wins(store, spark, monkeypatch):
    other = Store(spark, store.root, SCHEMAS, {"docs": "path"}, buckets=8)
    written = Store._written

    def slow(self, *a):
        out = written(self, *a)
        if self is store:
            monkeypatch.setattr(Store, "_written", written)
            other.commit(appended={"docs": docs(spark, [("theirs", 2)])})
        return out

    monkeypatch.setattr(Store, "_written", slow)
    with pytest.raises(Conflict):
        store.commit(appended={"docs": docs(spark, [("ours", 1)])})
    assert ("theirs", 2) in held(store) and ("ours", 1) not in held(store)
    store.commit(appended={"docs": docs(spark, [("ours", 1)])})
    assert {("theirs", 2), ("ours", 1)} <= set(held(store)) and store.versions() == [1, 2, 3]


def test_appends_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("snipspark.sources.store.PARTS", 3)
    s = Store(spark, str(tmp_path / "s"), SCHEMAS, {"docs": "path"})
    for i in range(8):
        s.commit(appended={"log": spark.createDataFrame([(i,)], "n int")})
        assert len(s.manifest()["tables"]["log"]["0"]) <= 3
    assert sorted(r.n for r in s.table("log").collect()) == list(range(8))


FILES = {
    "src/a.ts": 'import { Bee } from "./b";\nexport class Ant {\n  go() { return new Bee().buzz(); }\n}\n',
    "src/b.ts": "export class Bee {\n  buzz() { return 1; }\n}\n",
    "src/c.ts": 'import { Bee } from "./b.js";\nimport { Dog } from "./d";\nexport class Cat {\n  run() { helper(); return Dog; }\n}\n',
    "src/z.ts": "export function helper() { return 2; }\n",
    "src/far.ts": "export class Far {\n  lone() { return 3; }\n}\n",
}
CHANGES = [
    {"src/b.ts": "// later\nexport class Bee {\n  hum() { return 1; }\n}\n"},
    {"src/d.ts": "export class Dog {}\n", "src/z.ts": None},
    {"src/y.ts": "export function helper() { return 4; }\nexport class Bee {}\n", "src/b.ts": None},
    {"src/a.ts": None},
]


def test_changes_lead_to_what_an_index_from_nothing_has(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    for path, text in FILES.items():
        (tree / path).write_text(text)
    engine = Engine(spark, str(tmp_path / "grown"))
    engine.index(str(tree), now_ms=1)
    far = str(spark.createDataFrame([("src/far.ts",)], "file_path string").select(engine.store.place("edges", 64)).first()[0])
    for n, change in enumerate(CHANGES):
        before = engine.store.manifest()["tables"]["edges"]
        for path, text in change.items():
            (tree / path).write_text(text) if text is not None else (tree / path).unlink()
        stats = engine.index(str(tree), now_ms=1)
        assert stats["indexed"] + stats["removed"] == len(change)
        after = engine.store.manifest()["tables"]["edges"]
        # a file that nothing links with isn't written again
        assert after[far] == before[far]
        if n % 2 == 0:
            continue
        fresh = Engine(spark, str(tmp_path / f"fresh{n}"))
        fresh.index(str(tree), now_ms=1)
        for name in ("files", "symbols", "imports", "refs", "chunks", "nodes", "edges", "links", "terms", "vectors"):
            rows = [sorted(map(str, e.store.table(name).drop("mtime_ms").collect())) for e in (engine, fresh)]
            assert rows[0] == rows[1], (n, name)
