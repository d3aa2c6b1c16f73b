"""Queries over code: a project made from the pages table (a file, a symbol, an import and a reference for each page), names,
hierarchies, the cache and the store over the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import AS_OF, BM25, EDGES, HYBRID, asked, key_edges, near_sql, query, read, rounded, seeds, terms_sql, words
from .functions import bpe
from .operators import graph, hierarchy, names, ranking, search, tables
from .operators.keyword import keyword_top
from .plans.engine import Engine
from .sources.scratch import scratch
from .sources.store import Store
from .streaming import cache

#: Ranks of a public byte-pair vocabulary; a parameter of what counts with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: A page's file, and the places that its import names: by page_id modulo 4 a neighbour in its folder, a file of another folder under the
#: extension it is compiled to, a folder with an index file, or a package.
PROJECT = """p AS (SELECT page_id AS i, 'src/d' || page_id % 7 || '/f' || page_id || '.ts' AS path FROM pages),
 x AS (SELECT i, path, 'src/d' || k || '/sub/index.ts' AS sub, i % 4 AS kind FROM (SELECT *, (i + 2) % 7 AS k FROM p)),
 t AS (SELECT x.i, x.path, q.i AS other, q.path AS target FROM x JOIN p q ON q.i = CASE x.kind WHEN 0 THEN x.i + 7 WHEN 1 THEN x.i + 1 END UNION ALL SELECT i, path, NULL, sub FROM x WHERE kind = 2)"""


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def project(spark, sf_dir):
    """(files, symbols, imports, refs)."""
    i = F.col("page_id")
    path = lambda n: text("src/d", n % 7, "/f", n, ".ts")
    p = read(spark, sf_dir, "pages").select(i, path(i).alias("file_path"))
    subs = spark.range(7).select(text("src/d", F.col("id"), "/sub/index.ts").alias("path"))
    files = p.select(F.col("file_path").alias("path")).unionByName(subs)
    symbols = p.select(text("sym", i).alias("id"), text("n", i).alias("name"), F.lit("function").alias("kind"), "file_path")
    source = F.when(i % 4 == 0, text("./f", i + 7)).when(i % 4 == 1, text("../d", (i + 1) % 7, "/f", i + 1, ".js")).when(i % 4 == 2, text("../d", (i + 2) % 7, "/sub")).otherwise(F.lit("react"))
    names = F.when(i % 4 == 0, F.array(text("n", i + 7))).when(i % 4 == 1, F.array(text("n", i + 1))).otherwise(F.array().cast("array<string>"))
    imports = p.select(text("imp", i).alias("id"), "file_path", source.alias("source"), names.alias("imported_names"))
    refs = p.select(text("ref", i).alias("id"), text("sym", i).alias("from_symbol_id"), text("n", i + 3).alias("to_name"), F.when(i % 2 == 1, "call").otherwise("read").alias("kind"), "file_path")
    return files, symbols, imports, refs


@query(f"WITH {PROJECT} SELECT 'imp' || i AS id, path AS file_path, target AS target_path FROM t")
def resolve_imports(spark, sf_dir):
    files, symbols, imports, _ = project(spark, sf_dir)
    return graph.resolve_imports(imports, files, symbols)


@query(f"WITH {PROJECT} SELECT 'file:' || path AS id, 'file' AS kind, path AS name, path AS file_path, NULL AS symbol_kind FROM (SELECT path FROM p UNION SELECT 'src/d' || k || '/sub/index.ts' FROM range(7) r(k)) UNION ALL SELECT 'sym' || i, 'symbol', 'n' || i, path, 'function' FROM p")
def graph_nodes(spark, sf_dir):
    files, symbols, _, _ = project(spark, sf_dir)
    return graph.nodes(files, symbols)


@query(
    f"""WITH {PROJECT} SELECT 'file:' || path AS from_id, 'sym' || i AS to_id, 'contains' AS kind FROM p UNION ALL SELECT 'file:' || path, 'file:' || target, 'imports' FROM t
 UNION ALL SELECT 'file:' || path, 'sym' || other, 'imports' FROM t WHERE other IS NOT NULL UNION ALL SELECT 'sym' || p.i, 'sym' || q.i, CASE WHEN p.i % 2 = 1 THEN 'calls' ELSE 'references' END FROM p JOIN p q ON q.i = p.i + 3"""
)
def graph_built(spark, sf_dir):
    return graph.edges(*project(spark, sf_dir)).drop("file_path")


def references(spark, sf_dir):
    return key_edges(spark, sf_dir).where("kind = 'calls'").select(F.col("from_id").alias("from_symbol_id"), F.col("to_id").alias("to_symbol_id"))


@query(f"WITH {EDGES} SELECT from_id AS from_symbol_id, to_id AS to_symbol_id FROM e WHERE kind = 'calls' AND (from_id = 's3' OR to_id = 's3') UNION ALL SELECT from_id, to_id FROM e WHERE kind = 'calls' AND (from_id = 'p9' OR to_id = 'p9')")
def references_of_symbol(spark, sf_dir):
    refs = references(spark, sf_dir)
    return tables.references_of(refs, "s3").unionByName(tables.references_of(refs, "p9"))


@query("WITH r AS (SELECT DISTINCT l_partkey AS from_symbol_id, l_returnflag AS file_path FROM lineitem) SELECT from_symbol_id, file_path FROM r WHERE file_path = 'A' OR from_symbol_id IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def references_of_file(spark, sf_dir):
    lines, parts = read(spark, sf_dir, "lineitem", "part")
    refs = lines.select(F.col("l_partkey").alias("from_symbol_id"), F.col("l_returnflag").alias("file_path")).distinct()
    symbols = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 5, "A").otherwise("other").alias("file_path"))
    return tables.references_of_file(refs, symbols, "A").select("from_symbol_id", "file_path")


FOUND = f"{BM25}, b AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM (SELECT query_id, doc_id, round(bm25, 6) AS s FROM m))"


@query(f"WITH {FOUND}, u AS (SELECT query_id, doc_id, s AS semantic, 0 AS origin FROM b WHERE r <= 10 UNION ALL SELECT DISTINCT query_id, doc_id + 1, 0.3, 1 FROM b WHERE r <= 10) SELECT query_id, doc_id, CAST(arg_min(semantic, origin) AS DOUBLE) AS semantic, min(origin) AS origin FROM u GROUP BY query_id, doc_id")
def candidate_union(spark, sf_dir):
    found = keyword_top(search.held(words(spark, sf_dir)), asked(spark, sf_dir), 10).select("query_id", "doc_id", F.col("bm25").alias("semantic"))
    return ranking.candidate_union(found, found.select("query_id", (F.col("doc_id") + 1).alias("doc_id")), "query_id", "doc_id")


@query(
    f"""WITH n AS ({near_sql(2)}), c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'n1' WHEN 1 THEN 's1' ELSE 'p7' END AS query_id, CASE WHEN p_partkey % 4 > 0 THEN 'p' || p_partkey END AS symbol_id, 'd' || p_size % 5 AS file_path, CASE WHEN p_partkey % 5 > 0 THEN 'd1' END AS current_file FROM part)
 SELECT p_partkey, CASE WHEN current_file IS NULL THEN NULL WHEN symbol_id IS NOT NULL THEN coalesce(n.distance, 5) WHEN file_path = current_file THEN 0 ELSE 3 END AS distance FROM c LEFT JOIN n ON n.seed = c.query_id AND n.node_id = c.symbol_id"""
)
def graph_distances(spark, sf_dir):
    key, start = F.col("p_partkey"), F.element_at(F.array(F.lit("n1"), F.lit("s1"), F.lit("p7")), (F.col("p_partkey") % 3 + 1).cast("int"))
    c = read(spark, sf_dir, "part").select(key, start.alias("query_id"), F.when(key % 4 > 0, text("p", key)).alias("symbol_id"), text("d", F.col("p_size") % 5).alias("file_path"), F.when(key % 5 > 0, "d1").alias("current_file"))
    reached = graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 2).select(F.col("seed").alias("query_id"), "node_id", "distance")
    return ranking.distances(c, reached, "query_id").select("p_partkey", "distance")


# names
NAMED = "p AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_brand AS file_path FROM part)"


def named_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text(F.col("p_name"), " ", F.col("p_partkey")).alias("name"), F.col("p_brand").alias("file_path"))


@query(f"WITH {NAMED}, i AS (SELECT o_orderkey AS id, 'f' || o_custkey AS file_path, o_orderkey % 97 AS last FROM orders), f AS (SELECT last, arg_min(file_path, (name, id)) AS target_path FROM (SELECT DISTINCT last FROM i) JOIN p ON contains(lower(name), CAST(last AS VARCHAR)) GROUP BY last) SELECT id, file_path, target_path FROM i JOIN f USING (last)")
def resolve_imports_by_name(spark, sf_dir):
    """Packages that no file answers to go to the file of the first symbol whose name holds their last part."""
    symbols = named_parts(spark, sf_dir)
    imports = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text("f", F.col("o_custkey")).alias("file_path"), text("@scope/", F.col("o_orderkey") % 97).alias("source"), F.array().cast("array<string>").alias("imported_names"))
    return graph.resolve_imports(imports, symbols.select(F.col("file_path").alias("path")).distinct(), symbols, by_name=True)


@query(f"WITH {NAMED}, q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'T ' || c_custkey % 50 WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE 'GEAR' END AS pattern FROM customer WHERE c_nationkey = 3) SELECT query_id, count(*) AS found, min(id) AS first_id, max(id) AS last_id FROM q JOIN p ON contains(lower(name), lower(pattern)) GROUP BY query_id")
def symbol_substring(spark, sf_dir):
    i = F.col("c_custkey")
    patterns = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(i.alias("query_id"), F.when(i % 3 == 0, text("T ", i % 50)).when(i % 3 == 1, i.cast("string")).otherwise(F.lit("GEAR")).alias("pattern"))
    once = patterns.select(F.col("pattern").alias("asked"), "pattern").distinct()  # many ask for the same
    found = names.symbols_holding(once, named_parts(spark, sf_dir), "asked").groupBy("asked").agg(F.count("*").alias("found"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return patterns.join(found, F.col("pattern") == F.col("asked")).select("query_id", "found", "first_id", "last_id")


#: Parts under the part of half their number, orders under customers under nations under regions; some parts are their own parents, or each other's.
TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 41 = 0 THEN 'p' || p_partkey WHEN p_partkey % 43 = 5 THEN 'p' || (p_partkey + 1) WHEN p_partkey % 43 = 6 THEN 'p' || (p_partkey - 1) WHEN p_partkey > 1 THEN 'p' || CAST(floor(p_partkey / 2) AS BIGINT) END, p_name FROM part)"""


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, CAST(name AS VARCHAR) AS path FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, w.root, w.depth + 1, w.path || '.' || t.name FROM t JOIN w ON t.parent = w.id) SELECT t.id, root, depth, path FROM t LEFT JOIN w USING (id)")
def symbol_paths(spark, sf_dir):
    region, nation, customer, orders, part = read(spark, sf_dir, "region", "nation", "customer", "orders", "part")
    row = lambda df, a, key, up, name: df.select(text(a, F.col(key)).alias("id"), up.alias("parent_id"), F.col(name).cast("string").alias("name"))
    p = F.col("p_partkey")
    above = F.when(p % 41 == 0, text("p", p)).when(p % 43 == 5, text("p", p + 1)).when(p % 43 == 6, text("p", p - 1)).when(p > 1, text("p", F.floor(p / 2)))
    rows = row(region, "r", "r_regionkey", F.lit(None).cast("string"), "r_name").unionByName(row(nation, "n", "n_nationkey", text("r", F.col("n_regionkey")), "n_name")).unionByName(row(customer, "c", "c_custkey", text("n", F.col("c_nationkey")), "c_name"))
    return hierarchy.paths(rows.unionByName(row(orders, "o", "o_orderkey", text("c", F.col("o_custkey")), "o_orderkey")).unionByName(row(part, "p", "p_partkey", above, "p_name")))


@query(near_sql(3).replace("(VALUES ('n1'), ('s1'), ('p7')) v(s)", "(SELECT 'p' || p_partkey AS s FROM part)"))
def graph_neighbors_all(spark, sf_dir):
    """Three steps from every part."""
    return graph.neighbours(key_edges(spark, sf_dir), read(spark, sf_dir, "part").select(text("p", F.col("p_partkey")).alias("seed")), 3)


# the cache: events are operations on keys made of user numbers; two kinds of errors drop all keys that begin with a number, or all
OPS = """o AS (SELECT ts, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'set' WHEN event_type = 'view' THEN 'get' WHEN event_type = 'signup' THEN 'has' WHEN user_id % 10 < 7 THEN 'delete' WHEN user_id % 10 < 9 THEN 'invalidate' ELSE 'clear' END AS op,
 CASE WHEN event_type = 'error' AND user_id % 10 BETWEEN 7 AND 8 THEN 'u' || (user_id % 3 + 1) WHEN event_type = 'error' AND user_id % 10 = 9 THEN NULL ELSE 'u' || user_id END AS key, props AS value, CASE WHEN event_type = 'click' THEN CAST(user_id * 3600000 AS BIGINT) END AS ttl_ms FROM events)"""
ANSWERS = f"""WITH {OPS}, g AS (SELECT * FROM o WHERE op IN ('get', 'has')), k AS (SELECT ts, seq, key, op, value, ttl_ms FROM o WHERE op IN ('set', 'delete') UNION ALL SELECT w.ts, w.seq, k.key, 'delete', NULL, NULL FROM o w JOIN (SELECT DISTINCT key FROM o WHERE op IN ('set', 'get', 'has', 'delete')) k ON w.op = 'clear' OR (w.op = 'invalidate' AND starts_with(k.key, w.key))),
 l AS (SELECT g.ts, g.seq, g.op, g.key, arg_max(struct_pack(op := k.op, value := k.value, til := epoch_ms(k.ts) + k.ttl_ms), (k.ts, k.seq)) AS w FROM g LEFT JOIN k ON k.key = g.key AND (k.ts, k.seq) < (g.ts, g.seq) GROUP BY ALL)
 SELECT seq, op, key, hit, CASE WHEN hit AND op = 'get' THEN w.value END AS value FROM (SELECT *, coalesce(w.op = 'set' AND (w.til IS NULL OR epoch_ms(ts) <= w.til), false) AS hit FROM l)"""


def cache_operations(events):
    kind, user = F.col("event_type"), F.col("user_id")
    wide = (kind == "error") & (user % 10 >= 7)
    op = F.when(kind.isin("click", "purchase"), "set").when(kind == "view", "get").when(kind == "signup", "has").when(~wide, "delete").when(user % 10 < 9, "invalidate").otherwise("clear")
    key = F.when(wide & (user % 10 < 9), text("u", user % 3 + 1)).when(wide, F.lit(None)).otherwise(text("u", user))
    return events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), F.col("props").alias("value"), F.when(kind == "click", (user * 3600000).cast("long")).alias("ttl_ms"))


@query(ANSWERS)
def cache_replay(spark, sf_dir):
    return cache.replayed(cache_operations(read(spark, sf_dir, "events"))).drop("at")


@query(ANSWERS)
def cache_live_stream(spark, sf_dir):
    """The same as a stream over the table's files, until it has read them all."""
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path is a folder or one
    return cache.answered(cache.cache_stream(cache_operations(stream))).drop("at")


@query()
def token_counts(spark, sf_dir):
    """Byte-pair tokens of every document."""
    count = bpe.token_counter(VOCABULARY)
    return search.spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", count(F.col("text")).alias("tokens"))


#: Documents as children of the files that they came in: some files changed, some went.
BUCKETED = "SELECT path, sha256(text) AS hash, CAST(doc_id % 5 = 0 AND doc_id % 7 <> 0 AS BOOLEAN) AS new FROM (SELECT *, 'd' || doc_id AS path FROM documents) WHERE doc_id % 7 <> 0"


@query(BUCKETED)
def replace_by_bucket(spark, sf_dir):
    """A store's table after one commit that replaces a fifth of its rows and removes a seventh."""
    store = Store(spark, scratch(spark, "store"), {"docs": "path string, hash string, new boolean"}, {"docs": "path"})
    i = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", text("d", i).alias("path"), F.sha2("text", 256).alias("hash"))
    store.commit(whole={"docs": docs.withColumn("new", F.lit(False))})
    store.commit(replaced={"docs": (docs.where((i % 5 == 0) & (i % 7 != 0)).withColumn("new", F.lit(True)), docs.where((i % 5 == 0) | (i % 7 == 0)).select("path"))})
    return store.table("docs")


# the engine over a store made of the tables: documents are chunks, each with a symbol named after its source, in files of one remainder; line items link symbols
CHUNKS = """k AS (SELECT doc_id, 'f' || doc_id % 40 AS file_path, n_chars % 300 AS start_line, text, 'note ' || source AS symbol_name FROM documents),
 g AS (SELECT 'file:' || file_path AS from_id, 'y' || doc_id AS to_id, 'contains' AS kind FROM k UNION ALL SELECT DISTINCT 'y' || l_orderkey % 200, 'y' || l_partkey % 200, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0)"""
FUSED = HYBRID.replace("cosine * 0.25 FROM ck)", "cosine * 0.25 FROM ck UNION ALL SELECT query_id, doc_id, overlap * 0.75 FROM ov)").replace(" s AS (SELECT query_id, doc_id, sum(x) AS score", f""" ov AS (SELECT query_id, doc_id, len(list_intersect(qt, st)) / len(qt) AS overlap FROM (SELECT item_id AS query_id, list_distinct({terms_sql('text')}) AS qt FROM benchmark), (SELECT doc_id, list_distinct({terms_sql("'note ' || source")}) AS st FROM documents) WHERE len(list_intersect(qt, st)) > 0),
 s AS (SELECT query_id, doc_id, sum(x) AS score""").replace("round(score, 6)", "round(score, 9)").replace("DESC, doc_id)", "DESC, 'd' || doc_id)")


def engine_of_tables(spark, sf_dir):
    docs, lines = read(spark, sf_dir, "documents", "lineitem")
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    path, symbol = text("f", i % 40), text("y", i)
    e = Engine(spark, scratch(spark, "engine"))
    made = search.tokens(docs, "doc_id", "text", "source", "lang")
    terms = made.select(text("d", i).alias("chunk_id"), path.alias("file_path"), F.col("lang").alias("language"), F.lit("function").alias("symbol_kind"), text("note ", F.col("source")).alias("symbol_name"), "ts", "dl")
    chunks = docs.select(
        text("d", i).alias("id"), symbol.alias("symbol_id"), path.alias("file_path"), F.col("text").alias("content"), none.alias("hash"), F.col("lang").alias("language"), i.alias("ord"),
        text("note ", F.col("source")).alias("symbol_name"), F.lit("function").alias("symbol_kind"), none.alias("signature"), none.alias("parent_id"), (F.col("n_chars") % 300).cast("int").alias("start_line"), (F.col("n_chars") % 300 + 9).cast("int").alias("end_line"),
    )
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    uses = lines.where("l_linenumber = 1 and l_orderkey % 3 = 0").select(text("y", F.col("l_orderkey") % 200).alias("from_id"), text("y", F.col("l_partkey") % 200).alias("to_id"), kind.alias("kind")).distinct()
    edges = docs.select(text("file:", path).alias("from_id"), symbol.alias("to_id"), F.lit("contains").alias("kind")).unionByName(uses).withColumn("file_path", F.col("from_id"))
    files = docs.select(path.alias("path"), (AS_OF - (i % 40) * 3600000).alias("indexed_at_ms")).distinct().select("path", none.alias("hash"), F.lit(0).cast("long").alias("size"), none.alias("language"), F.lit(0).cast("long").alias("mtime_ms"), "indexed_at_ms")
    e.store.commit(whole={"chunks": chunks, "terms": terms, "edges": edges, "files": files})
    kept = e.store.table("terms")
    e.store.commit(whole={"vectors": e.embedder.embed(kept, "chunk_id", "ts").join(kept.select("chunk_id", "file_path"), "chunk_id").withColumn("provider", F.lit(e.embedder.name))})
    return e


def numbered(c):
    return F.substring(c, 2, 20).cast("long")


@query(f"{FUSED} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM h WHERE rank <= 20")
def engine_search(spark, sf_dir):
    found = engine_of_tables(spark, sf_dir).search(asked(spark, sf_dir), 20)
    return found.select("query_id", numbered("chunk_id").alias("doc_id"), rounded("score"), "rank")


#: Requests: an item's text as the task, for two of three the file that is open, in which alone is searched, and facts made from its number.
CONTEXT = f"""{FUSED.replace('WITH ', 'WITH RECURSIVE ', 1).replace('r <= 40', 'r <= 60')}, {CHUNKS},
 rq AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 > 0 THEN 'f' || item_id % 40 END AS current_file, CAST((item_id * 7) % 300 AS INTEGER) AS cursor_line, ['f1', 'f' || item_id % 5] AS open_files, ['f2'] AS recent_edits FROM benchmark),
 sc AS (SELECT query_id, current_file, doc_id FROM rq JOIN k ON file_path = current_file), nf AS (SELECT file_path, count(*) AS n, avg(dl) AS a FROM k JOIN l USING (doc_id) GROUP BY file_path), ff AS (SELECT file_path, term, count(*) AS df FROM p JOIN k USING (doc_id) GROUP BY file_path, term),
 mf AS (SELECT sc.query_id, sc.doc_id, sum(ln(1 + (nf.n - ff.df + 0.5) / (ff.df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * l.dl / greatest(nf.a, 1)))) AS bm25 FROM sc JOIN q ON q.query_id = sc.query_id JOIN p ON p.doc_id = sc.doc_id AND p.term = q.term JOIN ff ON ff.file_path = current_file AND ff.term = q.term JOIN nf ON nf.file_path = current_file JOIN l ON l.doc_id = sc.doc_id GROUP BY sc.query_id, sc.doc_id),
 cf AS (SELECT query_id, doc_id, coalesce(cosine, 0) AS cosine FROM sc LEFT JOIN c USING (query_id, doc_id) WHERE doc_id IN (SELECT doc_id FROM t_documents) AND query_id IN (SELECT query_id FROM t_benchmark) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(cosine, 0) DESC, 'd' || doc_id) <= 60),
 xf AS (SELECT query_id, doc_id, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1) * 0.75 AS x FROM mf UNION ALL SELECT query_id, doc_id, cosine * 0.25 FROM cf UNION ALL SELECT query_id, doc_id, overlap * 0.75 FROM ov JOIN sc USING (query_id, doc_id)),
 hf AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'd' || doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(x), 9) AS score FROM xf GROUP BY query_id, doc_id)),
 fd AS (SELECT query_id, doc_id, score, rank FROM h WHERE rank <= 30 AND query_id IN (SELECT query_id FROM rq WHERE current_file IS NULL) UNION ALL SELECT query_id, doc_id, score, rank FROM hf WHERE rank <= 30), o AS (SELECT from_id AS a, to_id AS b, kind FROM g UNION SELECT to_id, from_id, kind FROM g),
 sd AS (SELECT query_id, 'y' || doc_id AS seed FROM fd WHERE rank <= 5 AND score >= 0.1),
 w1 AS (SELECT DISTINCT seed, seed AS node_id, 0 AS d FROM sd UNION SELECT w1.seed, o.b, d + 1 FROM w1 JOIN o ON o.a = w1.node_id AND o.kind <> 'contains' WHERE d < 2),
 n1 AS (SELECT seed, node_id, row_number() OVER (PARTITION BY seed ORDER BY min(d), node_id) AS r FROM w1 WHERE node_id <> seed GROUP BY seed, node_id),
 more AS (SELECT DISTINCT query_id, CAST(node_id[2:] AS BIGINT) AS doc_id FROM sd JOIN n1 USING (seed) WHERE r <= 10 AND CAST(node_id[2:] AS BIGINT) IN (SELECT doc_id FROM documents)
  UNION SELECT query_id, doc_id FROM rq JOIN (SELECT file_path, doc_id, row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS r FROM k) ON file_path = current_file WHERE r <= 3),
 cd AS (SELECT query_id, doc_id, score AS semantic FROM fd UNION ALL SELECT query_id, doc_id, 0.3 FROM more ANTI JOIN fd USING (query_id, doc_id)),
 w2 AS (SELECT DISTINCT 'file:' || current_file AS seed, 'file:' || current_file AS node_id, 0 AS d FROM rq WHERE current_file IS NOT NULL UNION SELECT w2.seed, o.b, d + 1 FROM w2 JOIN o ON o.a = w2.node_id WHERE d < 3),
 n2 AS (SELECT seed, node_id, min(d) AS distance, row_number() OVER (PARTITION BY seed ORDER BY min(d), node_id) AS r FROM w2 WHERE node_id <> seed GROUP BY seed, node_id),
 dg AS (SELECT to_id, count(*) AS n FROM g GROUP BY to_id),
 fc AS (SELECT cd.query_id, cd.doc_id, k.text, semantic * 0.35 + CASE WHEN current_file IS NULL THEN 0 ELSE 1 / (1 + coalesce(n2.distance, 5)) END * 0.15 + CASE WHEN list_contains(open_files, file_path) THEN 0.1 ELSE 0 END + CASE WHEN list_contains(recent_edits, file_path) THEN 0.08 ELSE 0 END
   + CASE WHEN current_file = file_path THEN 1 / (1 + abs(cursor_line - start_line)) ELSE 0 END * 0.12 + exp(-(k.doc_id % 40) * 3600000 / 86400000.0) * 0.05 + ln(1 + coalesce(dg.n, 0)) * 0.05 AS score
  FROM cd JOIN k USING (doc_id) JOIN rq USING (query_id) LEFT JOIN n2 ON n2.seed = 'file:' || current_file AND n2.node_id = 'y' || k.doc_id AND n2.r <= 100 LEFT JOIN dg ON dg.to_id = 'y' || k.doc_id),
 rk AS (SELECT query_id, doc_id, round(score, 9) AS score, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, 'd' || doc_id) AS rank FROM fc)
 SELECT query_id, doc_id, rank, round(score, 6) AS score, CAST(run AS BIGINT) AS run FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM rk) WHERE run <= 4000"""


@query(CONTEXT)
def engine_context(spark, sf_dir):
    i = F.col("item_id")
    requests = read(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("task"), F.when(i % 3 > 0, text("f", i % 40)).alias("current_file"), ((i * 7) % 300).cast("int").alias("cursor_line"),
        F.array(F.lit("f1"), text("f", i % 5)).alias("open_files"), F.array(F.lit("f2")).alias("recent_edits"), F.lit(None).cast("string").alias("git_diff"),
    )
    chosen = engine_of_tables(spark, sf_dir).context(requests, max_tokens=4000, as_of_ms=AS_OF)
    return chosen.select("query_id", numbered("chunk_id").alias("doc_id"), "rank", rounded("score"), "run")
