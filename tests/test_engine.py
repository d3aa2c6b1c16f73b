"""The engine end to end on a small tree written here."""

import pytest

from snipspark.plans.engine import REQUEST, Engine, InvalidRequest, as_json

AUTH = """import { Http } from "./http";

// Keeps the session of a user
export class SessionKeeper {
  constructor(private http: Http) {}

  async renewToken(key: string): Promise<string> {
    const reply = await this.http.post("/renew", { key });
    return reply.token;
  }
}

export function checkToken(token: string): boolean {
  return token.length > 10;
}
"""
HTTP = """export class Http {
  async post(path: string, body: object): Promise<any> {
    return fetch(path, { body });
  }
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src/session.ts").write_text(AUTH)
    (root / "src/http.ts").write_text(HTTP)
    (root / "src/util.py").write_text("def slugify(text):\n    return text.lower()\n")
    (root / "node_modules/x.js").write_text("function hidden() {}")
    (root / "skip.ts").write_text("const a = 1")
    (root / ".gitignore").write_text("skip.ts\n")
    (root / "README.md").write_text("# Tokens\nHow tokens are renewed.\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    stats = e.index(str(tree), now_ms=1_000)
    assert stats["indexed"] == 4 and stats["skipped"] == 0 and not stats["errors"]
    return e


def test_second_index_does_nothing(engine, tree):
    stats = engine.index(str(tree))
    assert (stats["indexed"], stats["skipped"]) == (0, 4)


def test_symbols(engine):
    names = {r["name"]: r["kind"] for r in engine.symbols().collect()}
    assert names["SessionKeeper"] == "class" and names["renewToken"] == "method" and names["slugify"] == "function"
    assert "hidden" not in names and "a" not in names


def test_graph(engine):
    kinds = {(r["from_id"].split(":")[0], r["kind"]) for r in engine.store.table("edges").collect()}
    assert ("file", "contains") in kinds and ("file", "imports") in kinds
    near = [r["name"] for r in engine.neighbours("file:src/session.ts", 1).collect()]
    assert "SessionKeeper" in near and "src/http.ts" in near


def test_search_and_context(engine, spark):
    q = spark.createDataFrame([(1, "renew token"), (2, "lower case slug")], "query_id long, text string")
    best = {r["query_id"]: r["file_path"] for r in engine.search(q, 3).where("rank = 1").collect()}
    assert best[1] in ("src/session.ts", "README.md") and best[2] == "src/util.py"
    r = spark.createDataFrame([(1, "renew token", None, None, None, None, None), (2, "renew token", "src/http.ts", 1, ["src/http.ts"], None, None)], REQUEST)
    got = engine.context(r, as_of_ms=2_000).collect()
    assert {x["query_id"] for x in got} == {1, 2}
    assert sum(x["tokens"] for x in got if x["query_id"] == 1) < 1500
    assert any(x["file_path"] == "src/http.ts" for x in got if x["query_id"] == 2)
    assert set(got[0]["scores"]) >= {"semantic", "cursor"}


def test_many_files_are_one_plan(engine, spark):
    row = lambda i, f: (i, "renew token", f, 1, None, None, None)
    some = lambda n: spark.createDataFrame([row(i, f) for i, f in zip(range(n), ["src/http.ts", "src/session.ts", None] * n)], REQUEST)
    size = lambda df: str(df._jdf.queryExecution().optimizedPlan()).count("\n")
    many = engine.context(some(60), as_of_ms=2_000)
    assert size(many) == size(engine.context(some(3), as_of_ms=2_000))
    got = {}
    for r in many.collect():
        got.setdefault(r["query_id"] % 3, {}).setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    assert all(len({tuple(sorted(x)) for x in g.values()}) == 1 and len(g) == 20 for g in got.values())


def test_lookups_and_record(engine, spark):
    http = next(r for r in engine.symbols(name="Http").collect())
    assert {r["to_name"] for r in engine.references(http["id"]).collect()} >= {"Http"}
    assert engine.references(file_path="src/session.ts").count() and engine.by_id("symbols", http["id"]).count() == 1
    assert [r["source"] for r in engine.imports("src/session.ts").collect()] == ["./http"]
    assert {r["kind"] for r in engine.find("token").collect()} == {"symbol", "chunk"}
    r = spark.createDataFrame([(1, "renew token", None, None, None, None, None)], REQUEST)
    before = engine.metrics().first()
    chosen = engine.context(r, as_of_ms=2_000)
    tokens = sum(x["tokens"] for x in chosen.collect())
    after = engine.metrics().first()
    assert after["retrieved_tokens"] - before["retrieved_tokens"] == tokens > 0 and after["latency_ms"] > before["latency_ms"] and after["embedding_latency_ms"] > 0
    assert engine.metrics().first() == after  # counted once
    engine.record(r, chosen, 10)
    assert "src/session.ts" in engine.recall("retrieval", "renew token").first()["content"]
    assert '"rank":1' in as_json(chosen.where("rank = 1")).first()["json"]


def test_docs(engine, spark):
    q = spark.createDataFrame([(1, "tokens")], "query_id long, text string")
    assert [r["file_path"] for r in engine.docs(q).collect()] == ["README.md"]


def test_memory(engine):
    engine.remember("note", "k", "one", 10)
    engine.remember("note", "k", "two", 20)
    r = engine.recall("note").collect()
    assert [(x["content"], x["created_at"], x["updated_at"]) for x in r] == [("two", 10, 20)]
    engine.forget("note", "k")
    assert engine.recall("note").count() == 0
    with pytest.raises(InvalidRequest):
        engine.remember("no such", "k", "x")


def test_change_and_removal(engine, tree):
    (tree / "src/util.py").write_text("def other():\n    pass\n")
    (tree / "src/http.ts").unlink()
    stats = engine.index(str(tree))
    assert (stats["indexed"], stats["removed"]) == (1, 1)
    names = {r["name"] for r in engine.symbols().collect()}
    assert "other" in names and "slugify" not in names and "Http" not in names
    assert engine.store.table("edges").where("to_id like 'file:src/http.ts'").count() == 0
    assert engine.doctor()["healthy"]


def test_compress(engine, spark):
    text = AUTH + AUTH
    r = engine.compress(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert r[0]["result"]["compressed_tokens"] < r[0]["result"]["original_tokens"]
    assert all(n in r[0]["result"]["compressed"] for n in ("SessionKeeper", "renewToken", "checkToken"))
    assert r[1]["result"]["original_tokens"] == 0
