"""Operators that read less or spread more than a plain plan, against the plain plan or loops."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from snipspark.functions import bpe
from snipspark.functions import vectors as V
from snipspark.operators import budget, graph, hierarchy, keyword, names, search, vector_index
from snipspark.sources import changes
from snipspark.streaming import cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark):
    """Bytes shuffled so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


# vectors
def points(n, dims, seed=2, clusters=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((clusters, dims))
    return [(i, [float(c) for c in base[i % clusters] + 0.35 * rng.standard_normal(dims)]) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = points(900, 16) + [(2000, [0.0] * 16), (2001, [1.0, 2.0]), (2002, None)]
    path = str(tmp_path_factory.mktemp("v") / "v")
    spark.createDataFrame(rows, "id long, vector array<double>").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def store(spark, vectors, tmp_path):
    s = vector_index.VectorStore(spark, str(tmp_path / "s"), "long")
    s.build(vectors, cells=12)
    return s


def asked(vectors):
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def best(df):
    return sorted((r.query_id, r.rank, r.id, r.cosine) for r in df.collect())


def test_all_cells_are_exact(store, vectors):
    assert best(store.search(asked(vectors), "query_id", 7)) == best(search.nearest(vectors, asked(vectors), "id", "query_id", 7))


def test_few_cells_find_most_and_read_less(store, vectors):
    probes = store.tuned(asked(vectors), "query_id", 7)
    assert probes < 6
    truth = {(q, i) for q, _, i, _ in best(store.search(asked(vectors), "query_id", 7))}
    found = {(q, i) for q, _, i, _ in best(store.search(asked(vectors), "query_id", 7, probes))}
    assert len(truth & found) / len(truth) >= 0.85
    one = asked(vectors).where("query_id = 0")
    files = {f.split("bucket=")[1].split("/")[0] for f in store.table("vectors", [r.cell for r in store.search(one, "query_id", 3, 1).select("cell").distinct().collect()]).inputFiles()}
    assert len(files) == 1 < len({f.split("bucket=")[1].split("/")[0] for f in store.table("vectors").inputFiles()})


def test_upsert_moves_between_cells_and_delete(store, vectors):
    n, rows = store.count(), {r.id: r.vector for r in vectors.collect()}
    turned = vectors.where("id between 10 and 30").withColumn("vector", F.transform("vector", lambda c: -c))
    store.upsert(turned)
    assert store.count() == n
    got = {r.id: r.vector for r in store.table("vectors").collect()}
    assert all(got[i] == ([-c for c in v] if 10 <= i <= 30 else v) for i, v in rows.items())
    before = store.manifest()["tables"]["vectors"]
    store.delete(vectors.where("id in (5, 17)"))
    after = store.manifest()["tables"]["vectors"]
    assert store.count() == n - 2 and sum(after.get(b) != f for b, f in before.items()) <= 2
    store.upsert(vectors.where("id = 5"))
    assert store.count() == n - 1


def test_a_cell_of_most_rows_and_queries(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 1000, 0.5]) for i in range(400)], "id long, vector array<double>").withColumn("cell", F.lit(0))
    queries = spark.createDataFrame([(q, [1.0, q / 100, 0.4]) for q in range(30)], "query_id long, vector array<double>")
    got = vector_index.in_blocks(rows, queries.withColumn("cell", F.lit(0)), "id", "query_id", 5, each=(50, 7))
    assert best(got) == best(search.nearest(rows, queries, "id", "query_id", 5))


def test_pairs_of_vectors_are_compared_in_pieces():
    """A batch of 10,000 vectors and 4,096 centres or queries would be tables of hundreds of MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x, centres = rng.standard_normal((4000, 8)), rng.standard_normal((4096, 8))
    tracemalloc.start()
    near = vector_index.nearest_cells(x, centres, 3)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert (near == np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :3]).all() and (vector_index.nearest_cells(x, centres, 1)[:, 0] == near[:, 0]).all()


def test_nearest_within_groups_by_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "b", "c", None][i % 4] if i % 50 else "a", [float(c) for c in rng.standard_normal(3 if i % 9 else 2)]) for i in range(600)] + [(700, "a", None), (701, "b", [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, g string, vector array<double>").persist()
    q = v.where("id % 25 = 0 or id > 699").select(F.col("id").alias("query_id"), "g", "vector")
    got = search.nearest_within(v, q, "id", "query_id", "g", 6)
    pairs = v.join(q.withColumnRenamed("vector", "wanted"), "g").select("query_id", "id", F.round(V.cosine(F.col("vector"), F.col("wanted")), 6).alias("cosine"))
    assert best(got) == best(search.top_k(pairs, "query_id", "cosine", "id", 6))
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_no_vectors(spark, tmp_path):
    s = vector_index.VectorStore(spark, str(tmp_path / "s"), "long")
    s.build(spark.createDataFrame([], "id long, vector array<double>"))
    assert s.count() == 0 and not s.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), "query_id", 3).count()


# keywords
@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = lambda n: [words[int(400 * rng.random() ** 3)] for _ in range(n)]
    rows = [(i, " ".join(common(rng.choice([3, 10, 40, 200]))), "fr" if i % 3 else "en") for i in range(3000)]
    rows += [(5000 + i, " ".join([f"rare{j}" for j in range(12)] + common(10)), "fr") for i in range(15)] + [(6000, "", "fr"), (6001, None, "fr")]
    path = str(tmp_path_factory.mktemp("t") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    some = [" ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(rng.choice([1, 4, 12]))) for _ in range(25)]
    return spark.createDataFrame(list(enumerate(some)) + [(90, " ".join(f"rare{j}" for j in range(12)) + " w0 w1 w2"), (91, "nothing here"), (92, "")], "query_id long, text string")


@pytest.mark.parametrize("where", [None, "lang = 'fr'"])
def test_top_by_blocks_is_the_top(spark, texts, queries, where):
    tokens = search.tokens(texts, "doc_id", "text", "lang").persist()
    only = F.expr(where) if where else None
    plain = search.top_k(search.bm25(tokens, queries, where=only).withColumn("bm25", F.round("bm25", 6)), "query_id", "bm25", "doc_id", 10)
    key = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.bm25) for r in df.collect())
    assert key(keyword.keyword_top(tokens, queries, 10, where=only)) == key(plain)


def test_best_shuffles_no_pairs(spark, texts, queries):
    """Thousands of texts share a word with each query; what leaves the tasks is the best of each, of copies as many as are asked for."""
    copies = spark.range(20_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("w1 w2 w3 w9 other").alias("text"))
    tokens = search.tokens(texts.select("doc_id", "text").unionByName(copies), "doc_id", "text").persist()
    tokens.count()
    before = written(spark)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.bm25) for r in keyword.keyword_top(tokens, queries, 10).collect())
    assert written(spark) - before < 400_000
    plain = search.top_k(search.bm25(tokens, queries).withColumn("bm25", F.round("bm25", 6)), "query_id", "bm25", "doc_id", 10)
    assert got == sorted((r.query_id, r["rank"], r.doc_id, r.bm25) for r in plain.collect())


def test_blocks_are_left_out(texts, queries):
    tokens = search.tokens(texts, "doc_id", "text").persist()
    blocks = {r.query_id: (r.read, r.blocks) for r in keyword.Keyword(tokens, queries).top(10)[1].collect()}
    assert blocks[90][0] < blocks[90][1] / 3 and 91 not in blocks and 92 not in blocks


def test_scores_of_pairs(spark, texts, queries):
    tokens = search.tokens(texts, "doc_id", "text").persist()
    pairs = spark.createDataFrame([(q, d) for q in (0, 5, 90, 91) for d in (1, 2, 5003, 6000, 77777)], "query_id long, doc_id long")
    got = {(r.query_id, r.doc_id): round(r.bm25, 9) for r in keyword.Keyword(tokens, queries).of(pairs).collect()}
    want = {(r.query_id, r.doc_id): round(r.bm25, 9) for r in search.bm25(tokens, queries).join(pairs, ["query_id", "doc_id"]).collect()}
    assert got == want and len(want) > 2


# budgets
@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = [("big", i, rng.randrange(0, 40), rng.choice([1.0, 0.9, 0.5, 0.31, 0.1])) for i in range(4500)]
    rows += [(f"q{i % 30}", i, rng.choice([0, 10, 400, 1600, 9000]), rng.choice([1.0, 0.9, 0.5, 0.3, 0.1, 0.0])) for i in range(500)]
    return spark.createDataFrame(rows, "q string, id long, tokens long, score double").repartition(5)


def order():
    return [F.col("score").desc(), F.col("id")]


def test_a_group_of_most_rows_is_cut_like_a_window(items):
    key = lambda df: sorted((r.q, r.id, r.run) for r in df.collect())
    assert key(budget.fill(items, "q", 5000, order())) == key(budget.fill(items, "q", 5000, order(), few=True))
    for total in (12, 150, 5000):
        assert key(budget.adaptive(items, "q", total, order=order())) == key(budget.adaptive(items, "q", total, order=order(), few=True))


def test_only_heads_of_groups_are_numbered(spark, items):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = budget.numbered(items, "q", order(), cap=300)
    w = Window.partitionBy("q").orderBy(*order())
    want = items.withColumn("i", F.row_number().over(w) - 1).withColumn("run", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got, want = {(r.q, r.id): (r.i, r.run) for r in got.collect()}, {(r.q, r.id): (r.i, r.run) for r in want.collect()}
    assert all(want[k] == v for k, v in got.items()) and all(k in got for k, (_, run) in want.items() if run <= 300)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(k[0] == "big" for k in got) < 4500


# names
def test_names_that_hold_patterns(spark):
    rng = random.Random(6)
    own = ["".join(rng.choice("abAB.é") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "getUser", "getUsers", "x"]
    asked = ["".join(rng.choice("abA.é") for _ in range(rng.randrange(0, 6))) for _ in range(80)] + ["user", "USERS", "%", "_", "X", "zzz", None]
    got = {tuple(r) for r in names.holding(spark.createDataFrame([(p,) for p in asked], "pattern string"), names.name_postings(spark.createDataFrame([(n,) for n in own], "name string"))).collect()}
    assert got == {(p, n) for p in asked for n in own if p and n is not None and p.lower() in n.lower()}


def test_postings_are_not_broadcast(spark, tmp_path):
    """A file of names is small, their postings aren't."""
    spark.range(2000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name")).write.parquet(str(tmp_path / "n"))
    found = names.holding(spark.createDataFrame([(str(i),) for i in range(30)], "pattern string"), names.name_postings(spark.read.parquet(str(tmp_path / "n"))))
    built = plan(found).split("BroadcastExchange")[1:]
    assert built and not any("posexplode" in b for b in built)
    assert found.where("pattern = '7'").count() == sum("7" in str(i) for i in range(2000))


@pytest.mark.parametrize("legacy", [False, True])
def test_names_that_many_share(spark, legacy):
    """20,000 symbols and 5,000 references of one name and file meet as one row each: pairs would be 100 million."""
    rows = [(i, "set", "f") for i in range(20_000)] + [(30_000, "a.set", "g"), (30_001, "reset", "g"), (30_002, "Get", "h"), (30_003, "get", "k")]
    symbols = spark.createDataFrame(rows, "id long, name string, file_path string")
    refs = [(i, "f", "set") for i in range(5000)] + [(6000, "g", "set"), (6001, "h", "get"), (6002, "g", ""), (6003, "x", "x.get"), (6004, None, "get"), (6005, "f", None)]
    found = graph.resolve_names(spark.createDataFrame(refs, "ref_id long, file_path string, name string"), symbols, legacy)
    got = {r.ref_id: r.symbol_id for r in found.collect()}
    assert got == dict.fromkeys(range(5000), 0) | ({6000: 30_000, 6001: 30_002, 6002: 30_000, 6004: 30_003} if legacy else {6000: 0, 6001: 30_003, 6003: 30_003, 6004: 30_003})


def test_patterns_that_many_ask_for(spark, tmp_path):
    from snipspark import catalog_code

    rows = [(i, 3) for i in range(1, 900)] + [(5, 4)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    parts = [(i, f"blue {'gear' if i % 2 else 'bolt'}", "b", "t", 1, 1.0) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.query_id: (r.found, r.first_id, r.last_id) for r in catalog_code.symbol_substring(spark, str(tmp_path)).collect()}
    assert got[2] == got[899] == (30, 1, 59) and got[3] == got[753] == (5, 30, 38)


# the graph
def reach(edges, seed, depth, limit, known=None):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, front = {seed: 0}, [seed]
    for d in range(1, depth + 1):
        front = sorted({y for x in front for y in near.get(x, ()) if y not in dist and (known is None or y in known)})
        dist |= dict.fromkeys(front, d)
    return sorted(((d, n) for n, d in dist.items() if d))[:limit]


@pytest.mark.parametrize(("depth", "limit", "hub"), [(2, 7, 20), (3, 5, 3), (3, 1000, 10_000)])
def test_search_from_many_seeds(spark, monkeypatch, depth, limit, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(depth)
    edges = {(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(260)} | {("hub", f"n{i}") for i in range(0, 90)}
    seeds = [f"n{i}" for i in range(200)] + ["hub", "alone"]
    df = spark.createDataFrame([(a, b, "calls") for a, b in edges], "from_id string, to_id string, kind string")
    known = {f"n{i}" for i in range(0, 200)} - {"n7", "n8"} | {"hub"}
    for these in (None, known) if limit == 5 else (None,):
        nodes = None if these is None else spark.createDataFrame([(n,) for n in these], "id string")
        got = {}
        for r in graph.neighbours(df, spark.createDataFrame([(s,) for s in seeds + seeds[:3]] + [(None,)], "seed string"), depth, limit=limit, known=nodes).collect():
            got.setdefault(r.seed, []).append((r.distance, r.node_id))
        for s in seeds:
            assert sorted(got.get(s, [])) == reach(edges, s, depth, limit, these), s


@pytest.mark.parametrize(("depth", "limit", "head"), [(2, 7, 1), (3, 5, 2), (3, 100, 4)])
def test_lists_of_the_nearest_are_the_search(spark, monkeypatch, depth, limit, head):
    rng = random.Random(depth + limit)
    edges = {(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(300)} | {("hub", f"n{i}") for i in range(0, 90)} | {("n3", "n3")}
    df = spark.createDataFrame([(a, b, rng.choice(["calls", "imports"])) for a, b in edges], "from_id string, to_id string, kind string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(200)] + [("hub",), ("alone",), ("n1",), (None,)], "seed string")
    monkeypatch.setattr(graph, "HEAD", head)
    for more in ({}, {"kinds": ["calls"], "legacy_precedence": True}):
        monkeypatch.setattr(graph, "MANY", 1 << 30)
        want = sorted(tuple(r) for r in graph.neighbours(df, seeds, depth, limit=limit, **more).collect())
        monkeypatch.setattr(graph, "MANY", 1)
        got = sorted(tuple(r) for r in graph.neighbours(df, seeds, depth, limit=limit, **more).collect())
        assert got == want


def test_many_seeds_of_a_dense_graph(spark, monkeypatch):
    """500 seeds, each two steps from all 3,000 nodes: the pairs would be 1.5 million rows."""
    monkeypatch.setattr(graph, "MANY", 500)
    edges = spark.range(90_000).selectExpr("concat('s', id % 30) from_id", "concat('p', floor(id / 30)) to_id", "'calls' kind")
    seeds = spark.range(500).selectExpr("concat('p', id) seed")
    before = written(spark)
    assert graph.neighbours(edges, seeds, 3, limit=20).count() == 10_000 and written(spark) - before < 20_000_000


@pytest.mark.parametrize("size", [1, 3, 100])
def test_first_lists_of_rows_cut_anywhere(size):
    rng = random.Random(size)
    rows = sorted((f"n{rng.randrange(9)}", f"m{rng.randrange(6)}") for _ in range(80))
    table = pa.table({"a": [a for a, _ in rows], "b": [b for _, b in rows]})
    got = [(r["a"], r["ids"]) for batch in graph.first_lists(iter(table.to_batches(max_chunksize=size))) for r in batch.to_pylist()]
    assert got == [(n, [n, *sorted({b for a, b in rows if a == n})]) for n in sorted({a for a, _ in rows})]


def test_lists_of_seeds_alone(spark, monkeypatch):
    """Edges given more than once; what isn't asked for has no list."""
    monkeypatch.setattr(graph, "HEAD", 1)
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)}
    both = spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a), (a, b))], "a string, b string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 7)], "a string")
    got = {r.a: [(d, n) for d, n in zip(r.far, r.ids) if d] for r in graph.nearest_lists(both, 3, 6, seeds).collect()}
    assert got == {f"n{i}": want for i in range(0, 60, 7) if (want := reach(edges, f"n{i}", 3, 6))}


def test_paths_of_a_forest_with_cycles(spark):
    rng = random.Random(2)
    parent = {i: rng.randrange(i) if rng.random() < 0.9 and i else None for i in range(300)}
    parent |= {i: i - 1 for i in range(301, 420)} | {300: None, 500: 501, 501: 502, 502: 500, 503: 501, 504: 504, 505: 999}
    got = {r.id: (r.root, r.depth, r.path) for r in hierarchy.paths(spark.createDataFrame([(i, p, f"x{i}") for i, p in parent.items()], "id long, parent_id long, name string")).collect()}
    for i in parent:
        chain, at = [], i
        while at is not None and at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        ends = at is None or at not in parent
        assert got[i] == ((chain[-1], len(chain) - 1, ".".join(f"x{c}" for c in reversed(chain))) if ends else (None, None, None)), i


def test_rows_under_which_none_stands_are_moved_twice(spark):
    """100,000 rows under 50 rows in a chain: they are looked up by their id and by their parent, whatever the rounds."""
    rows = spark.range(100_050).selectExpr("id", "if(id < 50, nullif(id - 1, -1), id % 50) parent_id", "concat('n', id) name")
    before = written(spark)
    assert hierarchy.paths(rows).where("root = 0").count() == 100_050 and written(spark) - before < 5_000_000


# the cache
def operations(n, seed):
    rng = random.Random(seed)
    start, out = datetime(2024, 1, 1), []
    for i in range(n):
        op = rng.choices(["set", "get", "has", "delete", "invalidate", "clear"], [8, 8, 3, 2, 1, 0.3])[0]
        key = None if op == "clear" else rng.choice(["a", "a:", "b", ""]) if op == "invalidate" else f"{rng.choice('abc')}:{rng.randrange(6)}"
        out.append((start + timedelta(seconds=i // 3), i, op, key, f"v{i}" if op == "set" else None, rng.choice([None, 4000, 30_000]) if op == "set" else None))
    return out


def answers_by_loop(ops):
    held, out = {}, []
    for at, seq, op, key, value, ttl in ops:
        if op == "set":
            held[key] = (value, at + timedelta(milliseconds=ttl) if ttl else None)
        elif op == "delete":
            held.pop(key, None)
        elif op in ("invalidate", "clear"):
            held = {k: v for k, v in held.items() if not k.startswith(key or "")}
        else:
            hit = key in held and (held[key][1] is None or at <= held[key][1])
            out.append((seq, op, key, hit, held[key][0] if hit and op == "get" else None))
    return out


OPS = "at timestamp, seq long, op string, key string, value string, ttl_ms long"


def test_cache_of_a_batch_and_of_a_stream(spark, tmp_path):
    ops = operations(900, 1)
    want = answers_by_loop(ops)
    key = lambda df: sorted((r.seq, r.op, r.key, r.hit, r.value) for r in df.collect())
    assert key(cache.replayed(spark.createDataFrame(ops, OPS))) == want
    for i, part in enumerate((ops[:400], ops[400:])):
        spark.createDataFrame(part, OPS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert key(cache.answered(cache.cache_stream(stream, shards=3))) == want


def test_invalidations_dont_meet_all_keys(spark):
    """2,000 keys under 3,000 clears: pairs would be 6 million rows."""
    sets = spark.range(2000).selectExpr("timestamp_millis(id) at", "id seq", "'set' op", "concat('k', id) key", "'v' value", "cast(null as long) ttl_ms")
    clears = spark.range(3000).selectExpr("timestamp_millis(1000 + id % 7) at", "10000 + id seq", "'clear' op", "cast(null as string) key", "cast(null as string) value", "cast(null as long) ttl_ms")
    gets = spark.range(2000).selectExpr("timestamp_millis(5000) at", "20000 + id seq", "'get' op", "concat('k', id) key", "cast(null as string) value", "cast(null as long) ttl_ms")
    before = written(spark)
    got = cache.replayed(sets.union(clears).union(gets)).groupBy("hit").count().collect()
    assert {r["hit"]: r["count"] for r in got} == {True: 993, False: 1007} and written(spark) - before < 2_000_000


def test_an_invalidation_reads_no_entries():
    import pandas as pd

    reads = []

    class State(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

        def keys(self):
            reads.extend(self)
            return iter(list(dict.keys(self)))

        iterator = lambda self: (reads.extend(self), iter(list(self.items())))[1]

    class Value(list):
        exists, update = (lambda self: bool(self)), (lambda self, v: self.append(v))

    class Handle:
        timers = []
        getMapState, getValueState = (lambda self, *a: State()), (lambda self, *a: Value())
        registerTimer = timers.append

    entries = cache.Entries()
    entries.init(Handle())
    rows = [(pd.Timestamp(i, unit="s"), i, "set", f"k{i}", "v", 1000) for i in range(300)] + [(pd.Timestamp(400 + i, unit="s"), 400 + i, "invalidate", "k2", None, None) for i in range(300)] + [(pd.Timestamp(300, unit="s"), 350, "get", "k299", None, None), (pd.Timestamp(800, unit="s"), 800, "has", "k1", None, None)]
    out = pd.concat(list(entries.handleInputRows(0, iter([pd.DataFrame(rows, columns=["at", "seq", "op", "key", "value", "ttl_ms"])]), None)))
    assert [(r.seq, r.hit) for r in out.itertuples()] == [(350, True), (800, False)] and len(reads) < 10 and len(Handle.timers) <= 1
    assert ("k25",) not in entries.entries and ("k1",) in entries.entries


def test_scores_are_rounded_as_in_sql(spark):
    """A cosine of six places times a quarter is often a half at the seventh place."""
    import duckdb

    sql = dict(duckdb.sql("SELECT i, round(i / 1000000 * 0.25, 6) FROM range(-1000000, 1000000) r(i)").fetchall())
    x = F.col("id") / 1_000_000 * 0.25
    got = spark.range(-1_000_000, 1_000_000).select("id", search.rounded(x, 6).alias("ours"), F.round(x, 6).alias("sparks")).toArrow().to_pydict()
    assert all(sql[i] == v for i, v in zip(got["id"], got["ours"]))
    assert any(sql[i] != v for i, v in zip(got["id"], got["sparks"]))


# changes of a folder
def test_stream_of_changes(spark, tmp_path):
    tree, state, out = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "out")
    (tree / "d" / ".hidden").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    for name in ("a.ts", "b.ts", "d/c.ts", "d/.hidden/e.ts", "node_modules/x.ts"):
        (tree / name).write_text(name)
    seen = []

    def run():
        q = changes.change_stream(spark, str(tree), state, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        q.awaitTermination()
        rows = sorted((r.path, r.change) for r in spark.read.schema(changes.CHANGES).parquet(out).collect())
        new = rows.copy()
        for r in seen:
            new.remove(r)
        seen[:] = rows
        return new

    assert run() == [("a.ts", "added"), ("b.ts", "added"), ("d/.hidden/e.ts", "added"), ("d/c.ts", "added")]
    assert run() == []
    (tree / "a.ts").write_text("longer than before")
    (tree / "b.ts").unlink()
    (tree / "d" / "new.py").write_text("x")
    assert run() == [("a.ts", "changed"), ("b.ts", "removed"), ("d/new.py", "added")]
    assert run() == []


# token counts
def test_token_counts_are_the_librarys(spark):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "hello  world\n\n x", "don't we'll", "naïve 語語 😀😀", "a" * 3000, "".join(rng.choice("abcde") for _ in range(20_000)), " ".join("".join(rng.choice("etaoins") for _ in range(rng.randrange(1, 12))) for _ in range(300)), " \t\n ", "x=1;\n\tif (y) { return 12345678; }"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, t string")
    got = {r.id: r.n for r in rows.select("id", bpe.token_counter(VOCABULARY)(F.col("t")).alias("n")).collect()}
    assert got == {i: len(library.encode_ordinary(t)) for i, t in enumerate(texts)} | {99: 0}


def test_cosines_of_stored_floats(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<float>, b array<float>")
    assert math.isclose(df.select(V.cosine(F.col("a"), F.col("b"))).first()[0], 1.0)
