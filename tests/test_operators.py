"""Operators against plain loops, and published properties on inputs written here."""

import math
import random
import re
import time
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snipspark.functions import text as T
from snipspark.functions import vectors as V
from snipspark.operators import budget, compress, graph, ranking, search, tables
from snipspark.sources.files import Rules, scan
from snipspark.sources.parsing import parsed_file


def test_tokenizer(spark):
    df = spark.createDataFrame([("src/auth.refreshToken HTTPServer",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.search_terms(F.col("t"))).collect()]
    assert got[0] == ["src/auth.refreshtoken", "src/auth.refresh", "token", "src", "auth", "refreshtoken", "httpserver", "http", "server"]
    assert got[1] == got[2] == []


def test_related_texts_are_nearer(spark):
    d = spark.createDataFrame([(1, "function renewSession(token) { return token.renew() }"), (2, "class ShoppingCart { addItem(item) {} }"), (3, "")], "id long, t string")
    q = spark.createDataFrame([(9, "renew the session token")], "q long, t string")
    got = {r["id"]: r["cosine"] for r in search.nearest(V.hash_vectors(search.tokens(d, "id", "t"), "id"), V.hash_vectors(search.tokens(q, "q", "t"), "q"), "id", "q", 5).collect()}
    assert got[1] > got.get(2, 0) and 3 not in got


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, -1.0]


def chosen_by_loop(rows, total, cap=None):
    tokens, most = budget.caps(total, cap)
    out, run, top = [], 0, rows[0][1] if rows else 0
    for t, s in rows:
        rel = s / top if top > 0 else 1
        if len(out) >= most or (rel < 0.35 and len(out) >= 3) or (rel < 0.2 and out) or run + t > tokens:
            break
        out.append(t)
        run += t
    return out or ([rows[0][0]] if rows else [])


def test_adaptive_choice_is_the_loops(spark):
    rng = random.Random(5)
    cases = {q: sorted(((rng.choice([0, 10, 400, 1600]), rng.choice([1.0, 0.9, 0.5, 0.3, 0.1, 0.0, -0.2])) for _ in range(rng.randrange(1, 9))), key=lambda r: -r[1]) for q in range(120)}
    df = spark.createDataFrame([(q, i + 1, t, s) for q, rs in cases.items() for i, (t, s) in enumerate(rs)], "q long, rank int, tokens int, score double")
    for total in (12, 150):
        got = {}
        for r in budget.adaptive(df, "q", total).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["tokens"])
        assert got == {q: chosen_by_loop(rs, total) for q, rs in cases.items()}


def test_rank_prefers_open_file_and_near_cursor(spark):
    base = "q long, id string, file_path string, start_line int, semantic double, open_files array<string>, recent_edits array<string>, git_diff string, current_file string, cursor_line int, distance int, in_degree int, indexed_at_ms long"
    rows = [(1, "a", "src\\a.ts", 10, 0.5, ["src/a.ts"], None, None, "src/a.ts", 11, None, None, None), (1, "b", "src/a.ts", 200, 0.5, ["src/a.ts"], None, None, "src/a.ts", 11, None, None, None), (1, "c", "src/c.ts", 10, 0.5, ["src/a.ts"], None, None, "src/a.ts", 11, None, None, None)]
    got = [r["id"] for r in ranking.rank(spark.createDataFrame(rows, base), "q", "id", 0).orderBy("rank").collect()]
    assert got == ["a", "b", "c"] and math.isclose(sum(ranking.WEIGHTS.values()), 1)


def bfs(edges, seed, depth):
    seen, front = {seed: 0}, [seed]
    for d in range(1, depth + 1):
        front = sorted({b if a == x else a for x in front for a, b in edges if x in (a, b)} - seen.keys())
        seen |= dict.fromkeys(front, d)
    return {k: v for k, v in seen.items() if v}


def test_neighbours_are_breadth_first(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    e = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "from_id string, to_id string, kind string")
    s = spark.createDataFrame([("n1",), ("n7",)], "seed string")
    got = {}
    for r in graph.neighbours(e, s, 3).collect():
        got.setdefault(r["seed"], {})[r["node_id"]] = r["distance"]
    assert got == {x: bfs(pairs, x, 3) for x in ("n1", "n7") if bfs(pairs, x, 3)}


def test_import_paths(spark):
    files = spark.createDataFrame([("src/a.ts",), ("lib/index.ts",), ("src/b/c.js",)], "path string")
    imports = spark.createDataFrame([("1", "src/x.ts", "./a.js"), ("2", "src/x.ts", "../lib"), ("3", "src/b/d.ts", "./c"), ("4", "src/x.ts", "react")], "id string, file_path string, source string")
    got = {r["id"]: r["target_path"] for r in graph.resolve_imports(imports, files, None).collect()}
    assert got == {"1": "src/a.ts", "2": "lib/index.ts", "3": "src/b/c.js"}


def folded(text):
    """Block merging and skeletons by loops of their own."""
    groups = []
    for block in re.split("\n\n+", text):
        if groups and len(groups[-1]) + len(block) < 500:
            groups[-1] = f"{groups[-1]}\n{block}" if groups[-1] else block
        else:
            groups.append(block)
    shown, depth, body = [], 0, False
    for line in text.split("\n"):
        x = line.strip()
        if x.startswith(("//", "/**", "*", "import ", "export ")) or re.match(r"(class|function|interface|type|enum|const|let|var|async)\s", x):
            shown.append(line)
            if "{" in x:
                body, depth = True, depth + x.count("{") - x.count("}")
                shown += [compress.OMITTED] if depth > 0 else []
        elif body and depth > 0:
            depth += x.count("{") - x.count("}")
            if depth <= 0:
                body = False
                shown.append(line)
    return "\n\n".join(g for g in groups if g), "\n".join(shown)


def test_compression(spark):
    rng = random.Random(1)
    lines = ["class A {", "function f() {", "}", "  }", "", "  const x = 1", "foo(bar)", "// c", "* d", "export x {", "if {{", "}}", "async go", "typed", "  run() {", "x. y! z?", "a" * 260, "b" * 240 + " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(700 if i == 7 else 25))) for i in range(60)] + ["", "\n\n", "a\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", compress.merge(F.col("t")).alias("m"), compress.skeleton(F.col("t")).alias("s"), compress.dedupe(F.col("t")).alias("d")).collect():
        assert (r["m"], r["s"]) == folded(r["t"])
        seen = set()
        assert r["d"].split("\n") == [x for x in r["t"].split("\n") if not x.strip() or (x.strip() not in seen and not seen.add(x.strip()))]


def test_compression_pipeline(spark):
    code = "class Alpha {\n  run() {\n    return 1\n  }\n}\nclass Alpha {\n  run() {\n    return 1\n  }\n}\n\n\nconst x = 1\n"
    text = "a. b. c. d. e. f. g"
    df = spark.createDataFrame([(1, code), (2, text), (3, None)], "id long, text string")
    got = {r["id"]: r["result"] for r in compress.compress(df).collect()}
    assert "Alpha" in got[1]["compressed"] and [s["stage"] for s in got[1]["stages"]] == list(compress.STAGES)
    assert got[1]["identifiers"][0] == "Alpha" and got[3]["original_tokens"] == 0
    assert df.where("id = 2").select(compress.last_sentences(F.col("text"))).first()[0] == " c.  d.  e.  f.  g."
    one = compress.compress(df.where("id = 1"), target=25, count=lambda t: F.length(t).cast("long")).first()["result"]
    assert len(one["stages"]) > 1 and one["original_tokens"] == len(code)


def test_nearest_is_the_full_comparison(spark):
    rng = random.Random(4)
    v = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(v, "id long, vector array<double>").repartition(5)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) if any(a) and any(b) else 0.0
    got = {}
    for r in search.nearest(df, df.where("id < 3").withColumnRenamed("id", "q"), "id", "q", 7).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], round(r["cosine"], 6) + 0.0))
    assert got == {q: [(i, s) for s, i in sorted(((-cos(v[q][1], x) , i) for i, x in v))[:7] for s in [-s + 0.0]] for q in range(3)}


def test_embedders(spark):
    from snipspark.functions import embedders as E

    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "")], "id long, text string")
    tries = []

    def client(texts):
        return [[float(len(t)), 1.0] for t in texts]

    def broken(texts):
        tries.append(1)
        raise OSError("no answer")

    assert [r["id"] for r in E.embedder().embed(df, "id", "text").orderBy("id").collect()] == [1, 2]
    assert E.embedder("other").name == "local" and E.embedder("digest:m").name == "digest:m"
    a, b = (E.DigestEmbedder(m).embed(df, "id", "text").first()["vector"] for m in (None, "m"))
    assert len(a) == 384 and a != b
    assert E.embedder("remote", client).embed(df, "id", "text").where("id = 1").first()["vector"] == [10.0, 1.0]
    with pytest.raises(OSError):
        E.patient(broken, 3, 0.001)(["x"])
    ask = E.resilient(broken, client)
    assert len(tries) == 3 and ask(["x"]) == ask(["x"]) == [[1.0, 1.0]] and len(tries) == 4
    known = spark.createDataFrame([("x" * 64, [0.0])], "hash string, vector array<double>")
    assert {tuple(r["vector"]) for r in E.CachedEmbedder(E.ClientEmbedder("c", client), known).embed(df, "id", "text").collect()} == {(10.0, 1.0)}


def test_memory_and_upsert(spark):
    e = spark.createDataFrame([("note", "k", "new", 2), ("note", "k", "old", 1)], "category string, key string, content string, at long")
    assert [tuple(r) for r in tables.remember(e).collect()] == [("note", "k", "new", 1, 2)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.mark.parametrize(
    ("path", "rules", "out"),
    [("a/node_modules/x.js", ["node_modules"], True), ("a/b.min.js", ["*.min.js"], True), ("src/a.ts", ["/src"], True), ("lib/src/a.ts", ["/src"], False), ("src/a.ts", ["*.ts", "!a.ts"], False), ("gen/a.ts", ["gen/"], True), ("gen", ["gen/"], False)]
    + [("src/a/b.js", ["src/*.js"], False), ("src/b.js", ["src/*.js"], True), ("a/mygen/x.ts", ["**/gen"], False), ("a/gen/x.ts", ["**/gen"], True), ("gen/x.ts", ["**/gen"], True), ("a/b/c.ts", ["a/**"], True), ("a/b/c/d.ts", ["a/**/d.ts"], True), ("f1.ts", ["f[0-9].ts"], True), ("fx.ts", ["f[!0-9].ts"], True), ("a+b.ts", ["a+b.ts"], True), ("src/keep.ts", ["src", "!src/keep.ts"], True)],
)
def test_ignore_rules(path, rules, out):
    assert Rules(rules).ignored(path) is out


def test_scan(spark, tmp_path):
    names = ["pkg/__init__.py", "_app.tsx", "__tests__/a.ts", ".hidden/x.js", "deep/a/b/c/d/e.go", "dist/x.js", "pkg/skip.py", "notes.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x = '\xff\xc3\xa9'\n")
    (tmp_path / "big.py").write_bytes(b"#" * 1_000_001)
    (tmp_path / ".gitignore").write_text("skip.py\n")
    got = {r["path"]: r for r in scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(names[:5]) and got["_app.tsx"]["content"] == "x = '\ufffd\u00e9'\n" and got["_app.tsx"]["size"] == 10
    assert {r["path"] for r in scan(spark, f"file://{tmp_path}", ["pkg/"]).collect()} == set(names[1:5])


def test_parsers():
    py = parsed_file("m.py", "python", "from a.b import c\nclass K:\n    def m(self):\n        return c(1)\n\ndef top():\n    pass\n")
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in py["symbols"]] == [("K", "class", 1, 3), ("m", "method", 2, 3), ("top", "function", 5, 6)]
    assert py["imports"][0]["imported_names"] == ["c"] and ("c", "call") in {(r["to_name"], r["kind"]) for r in py["refs"]}
    assert py["symbols"][1]["parent_id"] == py["symbols"][0]["id"]
    js = parsed_file("m.js", "javascript", 'import { login } from "./auth.js";\nexport function go() { return login(); }\n')
    assert js["imports"][0]["source"] == "./auth.js" and js["symbols"][0]["exported"]
    assert js["chunks"][0]["content"].startswith("// File: m.js\n// Symbol: go (function)")


def test_documentation_and_long_files():
    block = "/**\n * What it does.\n */\nfunction one() {\n}\n// other\n\nfunction two() {\n}\nconst x = 1; // not of three\nlet y = 2\nfunction three() {\n}\n"
    docs = {s["name"]: s["documentation"] for s in parsed_file("a.ts", "typescript", block)["symbols"]}
    assert docs["one"] == "/**\n * What it does.\n */" and docs["two"] == "// other" and docs["three"] is None
    unit = "/* c */\nexport class K%d {\n  run(a: string) {\n    const v = this.go(a)\n    return v\n  }\n}\n"
    text = "".join(unit % i for i in range(1_000_000 // 80))
    began = time.time()
    many = parsed_file("a.ts", "typescript", text)
    assert time.time() - began < 6 and len(many["symbols"]) == 3 * text.count("class")
    assert all(s["exported"] for s in many["symbols"]) and {r["to_name"] for r in many["refs"] if r["kind"] == "call"} == {"run", "this.go"}


def test_stream(spark, tmp_path):
    from snipspark.streaming.ingest import chunk_stream, files_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_bytes(b"def f():\n    return '\xff'\n")
    q = chunk_stream(files_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["symbol_name"] for r in spark.table("chunks").collect()] == ["f"]


def test_terms_of_whole_collections(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B", "cd", "EF", "Gh", "7", "_", ".", "/", "-", " ", "\n", "é", "İ", "(", "\0"]) for _ in range(rng.randrange(120))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [None, "", " ", *texts]], "t string")
    assert all(r.a == r.b for r in df.select(T.search_terms(F.col("t")).alias("a"), T.terms_of_texts(F.col("t")).alias("b")).collect())


def test_called_names(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "B", "cd", "Ef", "$", "7", "_", " ", "\n", "\t", "(", "(", ")", ".", "é"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in ["", "(", "f (g(", *texts]], "t string")
    for r in df.select("t", F.filter(T.called(F.col("t")), lambda x: x != "").alias("got")).collect():
        assert r["got"] == re.findall(r"\b([a-z_$][\w$]*)\s*\(", r["t"], re.A), r["t"]


def test_batches_of_texts_are_bounded(spark):
    """A Python worker holds a batch as objects many times its bytes: no more than a few texts of 100 KB come at once."""
    before = spark.conf.get(search.BATCH_KEY, None)
    spark.conf.unset(search.BATCH_KEY)
    docs = spark.range(40).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 30000) text").coalesce(1)
    try:
        tokens = search.tokens(docs, "doc_id", "text")
        assert int(spark.conf.get(search.BATCH_KEY)) == search.BATCH_BYTES
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 40 and [r.dl for r in tokens.collect()] == [1] * 40
        spark.conf.set(search.BATCH_KEY, "12345678")  # the session's own stays
        search.tokens(docs, "doc_id", "text")
        assert spark.conf.get(search.BATCH_KEY) == "12345678"
    finally:
        spark.conf.set(search.BATCH_KEY, before) if before else spark.conf.unset(search.BATCH_KEY)


def test_terms_are_remembered_from_batch_to_batch():
    T.TERMS.clear()
    T.listed_terms(pa.array(["getToken x1"]))
    assert T.TERMS["getToken"] == ("gettoken", "get", "token") and set(T.TERMS) >= {"getToken", "x1"}


def test_hashed_places_are_bytes():
    """Eight bytes a feature, and the vector that they stand for."""
    places = V.Places()
    got = V.hashed(["ab", "cd"], places, 384)
    want = [0.0] * 384
    for feature, weight in (("ab", 1.0), ("cd", 1.0), ("ab cd", 0.5)):
        h = sha256(feature.encode()).digest()
        for i in range(4):
            want[h[i] % 384] += weight if h[i + 4] % 2 == 0 else -weight
    size = sum(x * x for x in want) ** 0.5
    assert all(isinstance(v, bytes) and len(v) == 8 for v in places.values()) and max(abs(a - b / size) for a, b in zip(got, want)) < 1e-12
