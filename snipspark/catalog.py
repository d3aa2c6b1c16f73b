"""The queries over the driver's tables, with the SQL that each is checked against.

Documents stand for chunks, embeddings for vectors, parts for symbols, foreign keys and page links for the graph,
events for memory entries and request logs, benchmark texts for queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import budget, compress, graph, keyword, ranking, search, tables
from .operators.vector_index import VectorStore
from .sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF = 1_704_067_200_000


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


def rounded(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


def terms_sql(text: str) -> str:
    """The tokenizer in SQL."""
    camel = r"regexp_replace(regexp_replace(seg, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    parts = f"list_concat(list_concat([lower(seg)], list_transform(list_filter(string_split({camel}, ' '), lambda p: p <> ''), lambda p: lower(p))), list_transform(list_filter(regexp_split_to_array(seg, '[./_-]+'), lambda p: length(p) > 1), lambda p: lower(p)))"
    return f"list_filter(flatten(list_transform(list_filter(regexp_split_to_array(coalesce({text}, ''), '[^a-zA-Z0-9_./-]+'), lambda s: s <> ''), lambda seg: {parts})), lambda t: length(t) >= 2)"


POSTINGS = f"p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents)), l AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark))"
BM25 = f"{POSTINGS}, m AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / greatest(a, 1)))) AS bm25 FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), n GROUP BY query_id, doc_id)"


def words(spark, sf_dir, *keep):
    return search.tokens(read(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# terms and BM25
@query(f"SELECT doc_id, term FROM (SELECT DISTINCT doc_id, unnest({terms_sql('text')}) AS term FROM documents)")
def tokenize_terms(spark, sf_dir):
    return search.postings(words(spark, sf_dir), "doc_id")


@query(f"WITH {POSTINGS} SELECT n AS docs, round(a, 6) AS avg_terms, (SELECT max(dl) FROM l) AS max_terms FROM n")
def token_stats(spark, sf_dir):
    return words(spark, sf_dir).agg(F.count("*").alias("docs"), F.round(F.avg("dl"), 6).alias("avg_terms"), F.max("dl").cast("long").alias("max_terms"))


@query(f"WITH {POSTINGS} SELECT term, df FROM f")
def doc_frequency(spark, sf_dir):
    return search.postings(words(spark, sf_dir), "doc_id").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {BM25} SELECT query_id, doc_id, r AS rank, s AS bm25 FROM (SELECT query_id, doc_id, round(bm25, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM m) WHERE r <= 10")
def bm25_topk(spark, sf_dir):
    return keyword.keyword_top(search.held(words(spark, sf_dir)), asked(spark, sf_dir), 10)


@query()
def bm25_blocks(spark, sf_dir):
    """For each query the blocks of documents that hold a term of it, and those that were read for its best 10."""
    return keyword.Keyword(search.held(words(spark, sf_dir)), asked(spark, sf_dir)).chosen(10)[-1]


@query(f"WITH {BM25} SELECT query_id, doc_id, r AS rank, s AS bm25 FROM (SELECT query_id, doc_id, round(bm25, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM m JOIN documents USING (doc_id) WHERE lang = 'fr') WHERE r <= 10")
def bm25_lang_filtered(spark, sf_dir):
    return keyword.keyword_top(search.held(words(spark, sf_dir, "lang")), asked(spark, sf_dir), 10, where=F.col("lang") == "fr")


@query(f"WITH {BM25} SELECT query_id, round(greatest(max(bm25), 1), 6) AS best FROM m GROUP BY query_id")
def max_normalised_keyword(spark, sf_dir):
    return keyword.Keyword(search.held(words(spark, sf_dir)), asked(spark, sf_dir)).best(1).groupBy("query_id").agg(F.round(F.greatest(F.max("bm25"), F.lit(1.0)), 6).alias("best"))


# vectors
COSINE = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def vector_queries(v):
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, vec_id, s AS cosine, r AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS r FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE r <= 10")
def vector_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return search.nearest(v, vector_queries(v), "vec_id", "query_id", 10, "embedding")


@query(f"SELECT query_id, vec_id, s AS cosine, r AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS r FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.label = 3) WHERE r <= 5")
def vector_topk_filtered(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return search.nearest(v.where("label = 3"), vector_queries(v), "vec_id", "query_id", 5, "embedding")


@query(f"SELECT query_id, vec_id, s AS cosine, r AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS r FROM embeddings v JOIN embeddings q USING (label) WHERE q.vec_id % 100 = 0) WHERE r <= 5")
def vector_topk_within(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    return search.nearest_within(v, queries, "vec_id", "query_id", "label", 5, "embedding")


EXACT = f"SELECT query_id, vec_id, s AS cosine, r AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 6) DESC, v.vec_id) AS r FROM {{v}} v, embeddings q WHERE q.vec_id % 100 = 0) WHERE r <= 10"


def vector_store(spark, sf_dir):
    """The vectors by cell, in a new folder."""
    store = VectorStore(spark, scratch(spark, "vectors"), "long", "array<float>")
    store.build(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("meta")))
    return store


def store_queries(spark, sf_dir):
    return vector_queries(read(spark, sf_dir, "embeddings")).withColumnRenamed("embedding", "vector")


@query(EXACT.format(v="embeddings"))
def vector_topk_full_probe(spark, sf_dir):
    return vector_store(spark, sf_dir).search(store_queries(spark, sf_dir), "query_id", 10).select("query_id", F.col("id").alias("vec_id"), "cosine", "rank")


@query()
def vector_topk_ivf(spark, sf_dir):
    """For each query the true 10 nearest, how many of them the nearest cells hold, and how many cells were read of how many."""
    store, queries = vector_store(spark, sf_dir), store_queries(spark, sf_dir)
    probes = store.tuned(queries, "query_id", 10)
    near = store.search(queries, "query_id", 10, probes).select("query_id", "id")
    exact = search.nearest(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, "id", "query_id", 10)
    return tables.recall_of(exact, near, "query_id", "id").select("query_id", "expected", "hit", "recall", F.lit(probes).alias("read"), F.lit(len(store.centres())).alias("cells"))


#: A store after rows divisible by 5 were deleted and those divisible by 7 turned round.
CHANGED = "(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda c: -c) ELSE embedding END AS embedding, label FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0)"


@query(EXACT.format(v=CHANGED + " ").replace("WHERE q.vec_id % 100 = 0", "WHERE q.vec_id % 100 = 0 AND v.label < 5"))
def vector_store_changes(spark, sf_dir):
    store = vector_store(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("meta"))
    store.delete(rows.where("id % 5 = 0"))
    store.upsert(rows.where("id % 7 = 0").withColumn("vector", F.transform("vector", lambda c: -c)))
    found = store.search(store_queries(spark, sf_dir), "query_id", 10, where=F.expr("int(meta['label']) < 5"))
    return found.select("query_id", F.col("id").alias("vec_id"), "cosine", "rank")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS mean_norm FROM embeddings GROUP BY label")
def embedding_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


def embedding_sql(table: str, key: str) -> str:
    """Unit hash embeddings as rows in SQL; first occurrences keep the order of terms."""
    byte = lambda i: f"CAST('0x' || substr(h, {1 + 2 * i}, 2) AS INTEGER)"
    places = ", ".join(f"{{'dim': {byte(i)} % 384, 'sign': CASE WHEN {byte(i + 4)} % 2 = 0 THEN 1.0 ELSE -1.0 END}}" for i in range(4))
    return (
        f"SELECT {key}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (SELECT {key}, p.dim AS dim, sum(w * p.sign) AS v FROM (SELECT {key}, w, unnest([{places}]) AS p FROM (SELECT {key}, sha256(f) AS h, w FROM ("
        f"SELECT {key}, term AS f, 1.0::DOUBLE AS w FROM t_{table} UNION ALL SELECT {key}, term || ' ' || nxt, 0.5 FROM (SELECT {key}, term, lead(term) OVER (PARTITION BY {key} ORDER BY pos) AS nxt FROM t_{table}) WHERE nxt IS NOT NULL)))  GROUP BY {key}, p.dim) WHERE v <> 0"
    )


def ordered_terms_sql(table: str, key: str, source: str) -> str:
    return f"t_{table} AS (SELECT {key}, term, min(pos) AS pos FROM (SELECT {key}, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM (SELECT {source} AS {key}, {terms_sql('text')} AS ts FROM {table})) GROUP BY {key}, term)"


@query(f"WITH {ordered_terms_sql('benchmark', 'query_id', 'item_id')} SELECT query_id, dim, round(value, 6) AS value FROM ({embedding_sql('benchmark', 'query_id')})")
def hash_embedding(spark, sf_dir):
    return V.hash_embeddings(asked(spark, sf_dir), "query_id", "text").select("query_id", "dim", rounded("value"))


@query("SELECT item_id, k AS dim, round(CAST('0x' || substr(sha256(text), 1 + 2 * (k % 32), 2) AS INTEGER) / 127.5 - 1, 6) AS value FROM benchmark, (SELECT CAST(unnest(range(0, 384)) AS INTEGER) AS k)")
def fake_embedding(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.digest_vector(F.col("text"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


HYBRID = f"""WITH {BM25}, {ordered_terms_sql('documents', 'doc_id', 'doc_id')}, {ordered_terms_sql('benchmark', 'query_id', 'item_id')},
 ed AS ({embedding_sql('documents', 'doc_id')}), eq AS ({embedding_sql('benchmark', 'query_id')}),
 c AS (SELECT query_id, doc_id, round(sum(ed.value * eq.value), 6) AS cosine FROM ed JOIN eq USING (dim) GROUP BY query_id, doc_id),
 ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS r FROM c) WHERE r <= 40),
 s AS (SELECT query_id, doc_id, sum(x) AS score FROM (SELECT query_id, doc_id, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1) * 0.75 AS x FROM m UNION ALL SELECT query_id, doc_id, cosine * 0.25 FROM ck) GROUP BY query_id, doc_id),
 h AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""


@query(f"{HYBRID} SELECT query_id, doc_id, score, rank FROM h WHERE rank <= 20")
def hybrid_search(spark, sf_dir):
    return search.hybrid(read(spark, sf_dir, "documents"), asked(spark, sf_dir), 20).select("query_id", "doc_id", rounded("score"), "rank")


@query(f"WITH q AS (SELECT item_id AS query_id, list_distinct({terms_sql('text')}) AS qt FROM benchmark), s AS (SELECT source, list_distinct({terms_sql('source')}) AS st FROM documents GROUP BY source) SELECT query_id, source, round(len(list_intersect(qt, st)) / len(qt), 6) AS overlap FROM q, s WHERE len(list_intersect(qt, st)) > 0 UNION ALL SELECT -1, p_name, round(len(list_intersect(['part', 'p1'], pt)) / 2, 6) FROM (SELECT DISTINCT p_name, {terms_sql('p_name')} AS pt FROM part) WHERE len(list_intersect(['part', 'p1'], pt)) > 0")
def symbol_overlap(spark, sf_dir):
    docs, parts = read(spark, sf_dir, "documents", "part")
    by_source = search.name_overlap(docs.select("source").distinct().withColumn("name", F.col("source")), asked(spark, sf_dir), "source", "name", "query_id", "text")
    one = spark.createDataFrame([(-1, "part p1")], "query_id long, text string")
    by_part = search.name_overlap(parts.select("p_name").distinct().withColumn("name", F.col("p_name")), one, "p_name", "name", "query_id", "text").withColumnRenamed("p_name", "source")
    return by_source.unionByName(by_part).select("query_id", "source", rounded("overlap"))


# symbols
def parts_as_symbols(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file_path"), F.lit("en").alias("language"))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file_path FROM part WHERE contains(lower(p_name), '1') AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_name, p_partkey LIMIT 100")
def symbol_lookup(spark, sf_dir):
    s = parts_as_symbols(spark, sf_dir)
    brand = s.agg(F.min("file_path")).first()[0]
    return tables.find_symbols(s, name="1", file_path=brand).drop("language")


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def symbol_page(spark, sf_dir):
    return tables.find_symbols(parts_as_symbols(spark, sf_dir), limit=20, offset=40).select("id", "name")


REFS = "r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, any_value(p_name) AS name, any_value(p2.b) AS file_path FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = k JOIN (SELECT p_partkey AS pk, p_brand AS b FROM part) p2 ON p2.pk = s GROUP BY ALL)"


def part_refs(spark, sf_dir):
    lines, parts = read(spark, sf_dir, "lineitem", "part")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"))
    named = one.join(parts.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k").join(parts.select(F.col("p_partkey").alias("s"), F.col("p_brand").alias("file_path")), "s")
    return named.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), "name", "file_path")


@query(f"WITH {REFS} SELECT ref_id, coalesce((SELECT min(p_partkey) FROM part WHERE p_name = r.name AND p_brand = r.file_path), (SELECT min(p_partkey) FROM part WHERE p_name = r.name)) AS symbol_id FROM r")
def resolve_names_exact(spark, sf_dir):
    return graph.resolve_names(part_refs(spark, sf_dir), parts_as_symbols(spark, sf_dir))


@query(f"WITH {REFS}, near AS (SELECT ref_id, arg_min(p_partkey, (p_name, p_partkey)) AS k FROM r JOIN part ON p_brand = file_path AND contains(lower(p_name), lower(name)) GROUP BY ref_id) SELECT r.ref_id, coalesce(k, (SELECT min(p_partkey) FROM part WHERE p_name = r.name)) AS symbol_id FROM r LEFT JOIN near USING (ref_id)")
def resolve_names_legacy(spark, sf_dir):
    return graph.resolve_names(part_refs(spark, sf_dir), parts_as_symbols(spark, sf_dir), legacy=True)


# links and the graph
LINKS = "e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"WITH {LINKS} SELECT page_id, href FROM e")
def link_extract(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"WITH {LINKS} SELECT href AS node_id, count(*) AS in_degree FROM e GROUP BY href")
def link_indegree(spark, sf_dir):
    return graph.in_degree(links(spark, sf_dir).select(F.col("page_id").alias("from_id"), F.col("href").alias("to_id")))


@query(f"WITH {LINKS} SELECT href AS node_id, count(*) AS in_degree, round(ln(1 + count(*)), 6) AS popularity FROM e GROUP BY href")
def popularity(spark, sf_dir):
    return graph.popularity(links(spark, sf_dir).select(F.col("page_id").alias("from_id"), F.col("href").alias("to_id"))).withColumn("popularity", F.round("popularity", 6))


EDGES = "e AS (SELECT 'n' || n_nationkey AS from_id, 'r' || n_regionkey AS to_id, 'contains' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'imports' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references' FROM customer UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'calls' FROM lineitem)"


def key_edges(spark, sf_dir):
    nation, supplier, customer, lines = read(spark, sf_dir, "nation", "supplier", "customer", "lineitem")
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("to_id"), F.lit(kind).alias("kind"))
    return edge(nation, "n", "n_nationkey", "r", "n_regionkey", "contains").unionByName(edge(supplier, "s", "s_suppkey", "n", "s_nationkey", "imports")).unionByName(edge(customer, "c", "c_custkey", "n", "c_nationkey", "references")).unionByName(edge(lines, "s", "l_suppkey", "p", "l_partkey", "calls").distinct())


def seeds(spark):
    return spark.createDataFrame([("n1",), ("s1",), ("p7",)], "seed string")


def near_sql(depth: int, out: str = "e", back: str = "e", limit: int = 100) -> str:
    return f"WITH RECURSIVE {EDGES}, o AS (SELECT from_id AS a, to_id AS b FROM {out} UNION SELECT to_id, from_id FROM {back}), w AS (SELECT s AS seed, s AS node_id, 0 AS d FROM (VALUES ('n1'), ('s1'), ('p7')) v(s) UNION SELECT w.seed, o.b, d + 1 FROM w JOIN o ON o.a = w.node_id WHERE d < {depth}) SELECT seed, node_id, distance FROM (SELECT seed, node_id, min(d) AS distance, row_number() OVER (PARTITION BY seed ORDER BY min(d), node_id) AS n FROM w WHERE node_id <> seed GROUP BY seed, node_id) WHERE n <= {limit}"


@query(f"WITH {EDGES} SELECT kind, count(*) AS edges, count(DISTINCT from_id) AS sources FROM e GROUP BY kind")
def graph_edges(spark, sf_dir):
    return key_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("from_id").alias("sources"))


@query(near_sql(1))
def graph_neighbors_d1(spark, sf_dir):
    return graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 1)


@query(near_sql(2))
def graph_neighbors_d2(spark, sf_dir):
    return graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 2)


@query(near_sql(3))
def graph_neighbors_d3(spark, sf_dir):
    return graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 3)


KIND = "(SELECT * FROM e WHERE kind IN ('imports', 'contains'))"


@query(near_sql(2, KIND, KIND))
def graph_neighbors_kinds_strict(spark, sf_dir):
    return graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 2, ["imports", "contains"])


@query(near_sql(2, "e", KIND))
def graph_neighbors_kinds_legacy(spark, sf_dir):
    return graph.neighbours(key_edges(spark, sf_dir), seeds(spark), 2, ["imports", "contains"], legacy_precedence=True)


@query(f"""WITH RECURSIVE {EDGES}, k AS (SELECT * FROM e WHERE kind IN ('calls', 'imports', 'references')), o AS (SELECT from_id AS a, to_id AS b FROM k UNION SELECT to_id, from_id FROM k),
 f AS (SELECT query_id, seed FROM (SELECT p_brand AS query_id, 'p' || p_partkey AS seed, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5),
 w AS (SELECT DISTINCT seed, seed AS node_id, 0 AS d FROM f UNION SELECT w.seed, o.b, d + 1 FROM w JOIN o ON o.a = w.node_id WHERE d < 2),
 n AS (SELECT seed, node_id, row_number() OVER (PARTITION BY seed ORDER BY min(d), node_id) AS r FROM w WHERE node_id <> seed GROUP BY seed, node_id)
 SELECT DISTINCT query_id, node_id || '/1' AS chunk_id FROM f JOIN n USING (seed) WHERE r <= 10 AND node_id[1] IN ('p', 's')""")
def graph_expand_candidates(spark, sf_dir):
    named = lambda df, mark, key: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("symbol_id"))
    symbols = named(read(spark, sf_dir, "part"), "p", "p_partkey").unionByName(named(read(spark, sf_dir, "supplier"), "s", "s_suppkey"))
    # a symbol's first chunk is the one that counts
    chunks = symbols.select("symbol_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("ord")).withColumn("chunk_id", F.concat_ws("/", "symbol_id", F.col("ord").cast("string")))
    found = search.top_k(read(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", 30).select(F.col("p_brand").alias("query_id"), "rank", F.lit(0.5).alias("score"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol_id"))
    return graph.expand(found, key_edges(spark, sf_dir), chunks, 1000)


# ranking
CANDIDATES = f"""{BM25}, b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS found FROM m),
 c AS (SELECT b.query_id, d.doc_id, d.source AS file_path, d.n_chars % 300 AS start_line, 'src' || b.query_id % 20 AS current_file, (b.query_id * 7) % 300 AS cursor_line, ['src1', 'src' || b.query_id % 5] AS open_files, ['src2'] AS recent_edits, '+++ b/src3' || chr(10) || '+++ b/src4' AS git_diff, 1 / (1 + found) AS semantic, CASE WHEN d.doc_id % 4 < 3 THEN d.doc_id % 4 END AS distance, CASE WHEN d.doc_id % 5 > 0 THEN d.doc_id % 5 END AS in_degree, CASE WHEN d.doc_id % 6 > 0 THEN {AS_OF} - (d.doc_id % 6) * 3600000 END AS indexed_at_ms
 FROM b JOIN documents d USING (doc_id) WHERE found <= 30),
 x AS (SELECT *, semantic AS f_semantic, coalesce(1 / (1 + distance), 0) AS f_dependency, CASE WHEN list_contains(open_files, file_path) THEN 1.0 ELSE 0 END AS f_open_files, CASE WHEN file_path IN ('src3', 'src4') THEN 1.0 ELSE 0 END AS f_git_diff, CASE WHEN list_contains(recent_edits, file_path) THEN 1.0 ELSE 0 END AS f_recent_edits, CASE WHEN current_file = file_path THEN 1 / (1 + abs(cursor_line - start_line)) ELSE 0 END AS f_cursor, CASE WHEN indexed_at_ms IS NOT NULL THEN exp(-({AS_OF} - indexed_at_ms) / 86400000.0) ELSE 0 END AS f_recency, coalesce(ln(1 + in_degree), 0) AS f_popularity FROM c)"""


def candidates(spark, sf_dir):
    """The 30 documents that the keyword search finds for each item, with the facts of a request made up from their numbers."""
    found = keyword.keyword_top(search.held(words(spark, sf_dir)), asked(spark, sf_dir), 30).select("query_id", "doc_id", (1 / (1 + F.col("rank"))).alias("semantic"))
    d = found.join(read(spark, sf_dir, "documents").drop("text"), "doc_id")
    return d.select(
        "query_id", "doc_id", F.col("source").alias("file_path"), (F.col("n_chars") % 300).alias("start_line"), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("current_file"), ((F.col("query_id") * 7) % 300).alias("cursor_line"),
        F.array(F.lit("src1"), F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string"))).alias("open_files"), F.array(F.lit("src2")).alias("recent_edits"), F.lit("+++ b/src3\n+++ b/src4").alias("git_diff"), "semantic",
        F.when(F.col("doc_id") % 4 < 3, F.col("doc_id") % 4).alias("distance"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5).alias("in_degree"), F.when(F.col("doc_id") % 6 > 0, AS_OF - (F.col("doc_id") % 6) * 3600000).alias("indexed_at_ms"),
    )


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, {', '.join(f'round(CAST(f_{n} AS DOUBLE), 6) AS f_{n}' for n in ranking.WEIGHTS)} FROM x")
def rank_factors(spark, sf_dir):
    return ranking.factors(candidates(spark, sf_dir), AS_OF).select("query_id", "doc_id", *(F.round(F.col(f"f_{n}").cast("double"), 6).alias(f"f_{n}") for n in ranking.WEIGHTS))


@query(f"WITH {CANDIDATES}, s AS (SELECT query_id, doc_id, CAST({' + '.join(f'f_{n} * {w}' for n, w in ranking.WEIGHTS.items())} AS DOUBLE) AS score FROM x) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 20")
def rank_topk(spark, sf_dir):
    x = ranking.rank(candidates(spark, sf_dir), "query_id", "doc_id", AS_OF).withColumn("score", F.round("score", 9)).drop("rank")
    return search.top_k(x, "query_id", "score", "doc_id", 20).select("query_id", "doc_id", rounded("score"), "rank")


# budgets
ITEMS = "x AS (SELECT source AS query_id, doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, 1.0 / (1 + doc_id % 17) AS score, row_number() OVER (PARTITION BY source ORDER BY 1.0 / (1 + doc_id % 17) DESC, doc_id) AS rank FROM documents)"


def items(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), (1.0 / (1 + F.col("doc_id") % 17)).alias("score"))


def best_first():
    return [F.col("score").desc(), F.col("doc_id")]


@query(f"WITH {ITEMS} SELECT query_id, doc_id, CAST(run AS BIGINT) AS run FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM x) WHERE run <= 5000")
def budget_fill(spark, sf_dir):
    return budget.fill(items(spark, sf_dir), "query_id", 5000, best_first()).select("query_id", "doc_id", "run")


@query(f"WITH {ITEMS}, y AS (SELECT *, rank - 1 AS i, first_value(score) OVER w AS top, sum(tokens) OVER w AS run FROM x WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)), z AS (SELECT *, i < 20 AND run <= 8000 AND NOT (top > 0 AND ((score / top < 0.35 AND i >= 3) OR (score / top < 0.2 AND i >= 1))) AS ok FROM y), k AS (SELECT *, min(CAST(ok AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS keep FROM z), a AS (SELECT *, max(keep) OVER (PARTITION BY query_id) AS kept FROM k) SELECT query_id, doc_id, CAST(run AS BIGINT) AS run FROM a WHERE keep = 1 OR (i = 0 AND kept = 0)")
def adaptive_select(spark, sf_dir):
    return budget.adaptive(items(spark, sf_dir), "query_id", 1000, order=best_first()).select("query_id", "doc_id", "run")


@query(f"WITH {ITEMS} SELECT query_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / 5000, 6) AS utilisation FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM x) WHERE run <= 5000 GROUP BY query_id")
def budget_utilisation(spark, sf_dir):
    return budget.utilisation(budget.fill(items(spark, sf_dir), "query_id", 5000, best_first()), "query_id", 5000).select("query_id", "total_tokens", rounded("utilisation"))


# compression
@query("SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY pos) AS n FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE n = 1 OR trim(line) = '' GROUP BY doc_id")
def dedupe_lines(spark, sf_dir):
    return compress.line_rows(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def trimmed_sql(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def deduped_sql(text: str) -> str:
    trims = f"list_transform(string_split({text}, chr(10)), lambda y: {trimmed_sql('y')})"
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x, i: {trimmed_sql('x')} = '' OR list_position({trims}, {trimmed_sql('x')}) = i), chr(10))"


def merged_sql(text: str) -> str:
    blocks = f"list_transform(regexp_split_to_array({text}, '\\n{{2,}}'), lambda b: {{'done': '', 'cur': b}})"
    flushed = "a.done || CASE WHEN a.cur = '' THEN '' WHEN a.done = '' THEN a.cur ELSE chr(10) || chr(10) || a.cur END"
    fold = f"list_reduce({blocks}, lambda a, x: CASE WHEN length(a.cur) + length(x.cur) < 500 THEN {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END}} ELSE {{'done': {flushed}, 'cur': x.cur}} END, {{'done': '', 'cur': ''}})"
    return f"list_transform([{fold}], lambda a: {flushed})[1]"


def skeleton_sql(text: str, most: int | None = None) -> str:
    bare = trimmed_sql("x")
    keep = f"regexp_matches({bare}, '^(//|/\\*\\*|\\*|import |export |(class|function|interface|type|enum|const|let|var|async)\\s)')"
    count = lambda c: f"(length({bare}) - length(replace({bare}, '{c}', '')))"
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: {{'line': x, 'keep': {keep}, 'opens': contains(x, '{{'), 'depth': {count('{')} - {count('}')}, 'inside': false}})"
    deeper = "a.depth + v.depth"
    kept = f"{{'line': a.line || chr(10) || v.line || CASE WHEN v.opens AND {deeper} > 0 THEN chr(10) || '{compress.OMITTED}' ELSE '' END, 'keep': false, 'opens': false, 'depth': CASE WHEN v.opens THEN {deeper} ELSE a.depth END, 'inside': a.inside OR v.opens}}"
    within = f"{{'line': CASE WHEN {deeper} <= 0 THEN a.line || chr(10) || v.line ELSE a.line END, 'keep': false, 'opens': false, 'depth': {deeper}, 'inside': {deeper} > 0}}"
    out = f"substr(list_reduce({lines}, lambda a, v: CASE WHEN v.keep THEN {kept} WHEN a.inside AND a.depth > 0 THEN {within} ELSE a END, {{'line': '', 'keep': false, 'opens': false, 'depth': 0, 'inside': false}}).line, 2)"
    return f"list_transform([{out}], lambda o: CASE WHEN length(o) > {most} THEN substr(o, 1, {most}) || chr(10) || '{compress.TRUNCATED}' ELSE o END)[1]" if most else out


NAMES = r"list_filter(list_concat(list_concat(regexp_extract_all({0}, '\b(?:class|interface|type|enum|function|const|let|var)\s+([A-Za-z_$][\w$]*)', 1), regexp_extract_all({0}, '\b([A-Z][A-Za-z0-9_]*)\b', 1)), regexp_extract_all({0}, '\b([a-z_$][\w$]*)\s*\(', 1)), lambda n: length(n) > 1)"


@query(f"SELECT doc_id, sha256({merged_sql('text')}) AS merged_sha256 FROM documents")
def merge_blocks(spark, sf_dir):
    return search.spread(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(compress.merge(F.col("text")), 256).alias("merged_sha256"))


@query(f"SELECT doc_id, sha256({skeleton_sql('text')}) AS skeleton_sha256 FROM documents")
def skeleton(spark, sf_dir):
    return search.spread(read(spark, sf_dir, "documents")).select("doc_id", F.sha2(compress.skeleton(F.col("text")), 256).alias("skeleton_sha256"))


@query("WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x) <> '') AS s FROM conversations), o AS (SELECT conv_id, turn, array_to_string(s[greatest(len(s) - 4, 1):], '. ') AS o FROM s) SELECT conv_id, turn, CASE WHEN ends_with(o, '.') THEN o ELSE o || '.' END AS summary FROM o")
def last_sentences(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", compress.last_sentences(F.col("text")).alias("summary"))


@query(r"SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(text, '\b(?:class|interface|type|enum|function|const|let|var)\s+([A-Za-z_$][\w$]*)', 1), regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]*)\b', 1)), regexp_extract_all(text, '\b([a-z_$][\w$]*)\s*\(', 1))) AS name FROM documents) WHERE length(name) > 1")
def identifiers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("name"))


COMPRESSED = f"""WITH a AS (SELECT doc_id, text, {deduped_sql('text')} AS s1 FROM documents),
 b AS (SELECT *, CASE WHEN ceil(length(s1) / 4) > 200 THEN {merged_sql('s1')} END AS s2 FROM a),
 c AS (SELECT *, CASE WHEN ceil(length(s2) / 4) > 200 THEN {skeleton_sql('s2', 800)} END AS s3 FROM b),
 d AS (SELECT *, CASE WHEN ceil(length(s3) / 4) > 200 THEN list_filter(regexp_split_to_array(s3, '[.!?\\n]+'), lambda x: trim(x) <> '') END AS parts FROM c),
 e AS (SELECT *, array_to_string(parts[greatest(len(parts) - 9, 1):], '. ') AS o FROM d),
 f AS (SELECT *, CASE WHEN ends_with(o, '.') THEN o ELSE o || '.' END AS s4 FROM e),
 g AS (SELECT *, coalesce(s4, s3, s2, s1) AS now, {NAMES.format('text')} AS found FROM f),
 h AS (SELECT doc_id, text, 1 + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT AS stages, list_reduce(list_filter(found, lambda n, i: list_position(found, n) = i), lambda t, n: CASE WHEN contains(t, n) THEN t ELSE t || chr(10) || '{compress.PRESERVED}' || n END, now) AS compressed FROM g),
 i AS (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS original_tokens, CAST(ceil(length(compressed) / 4) AS BIGINT) AS compressed_tokens FROM h)
 SELECT doc_id, original_tokens, compressed_tokens, greatest(original_tokens - compressed_tokens, 0) AS saved_tokens, stages, sha256(compressed) AS compressed_sha256 FROM i"""


@query(COMPRESSED)
def compress_pipeline(spark, sf_dir):
    c = compress.compress(read(spark, sf_dir, "documents").select("doc_id", "text"), target=200)
    return c.select("doc_id", "result.original_tokens", "result.compressed_tokens", "result.saved_tokens", F.size("result.stages").alias("stages"), F.sha2("result.compressed", 256).alias("compressed_sha256"))


# memory, expiry, metrics
@query("SELECT event_type AS category, CAST(user_id AS VARCHAR) AS key, arg_max(props, (ts, props)) AS content, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY ALL")
def memory_latest(spark, sf_dir):
    return tables.remember(entries(spark, sf_dir))


def entries(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("content"), F.col("ts").alias("at"))


@query("SELECT event_type AS category, CAST(user_id AS VARCHAR) AS key, max(ts) AS updated_at FROM events WHERE event_type = 'error' GROUP BY ALL ORDER BY updated_at DESC, key LIMIT 100")
def memory_recall(spark, sf_dir):
    return tables.recall(tables.remember(entries(spark, sf_dir)), "error").select("category", "key", "updated_at")


@query("SELECT event_type AS category, count(DISTINCT user_id) AS entries FROM events WHERE event_type <> 'view' GROUP BY event_type")
def memory_forget(spark, sf_dir):
    return tables.forget(tables.remember(entries(spark, sf_dir)), "view").groupBy("category").agg(F.count("*").alias("entries"))


@query("SELECT event_id FROM events WHERE value < 20 OR ts + INTERVAL 1 DAY * CAST(floor(value / 20) AS INTEGER) >= (SELECT max(ts) FROM events)")
def ttl_live_entries(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("value") >= 20, F.expr("ts + make_dt_interval(cast(floor(value / 20) as int))")))
    last = e.agg(F.max("ts").alias("now"))
    return tables.live(e.join(F.broadcast(last)), F.col("now")).select("event_id")


LOG = "l AS (SELECT CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'purchase' THEN 'compression' WHEN 'click' THEN 'embedding' ELSE 'ranking' END AS kind, user_id AS tokens, user_id % 7 AS saved, event_id % 100 AS latency_ms, event_id % 3 = 0 AS hit FROM events)"
USAGE = f"WITH {LOG}, u AS (SELECT CAST(coalesce(sum(tokens) FILTER (kind = 'retrieval'), 0) AS BIGINT) AS retrieved_tokens, CAST(coalesce(sum(tokens) FILTER (kind = 'compression'), 0) AS BIGINT) AS compressed_tokens, CAST(coalesce(sum(saved) FILTER (kind = 'compression'), 0) AS BIGINT) AS saved_tokens, CAST(coalesce(sum(latency_ms) FILTER (kind = 'retrieval'), 0) AS BIGINT) AS latency_ms, count(*) FILTER (kind = 'retrieval' AND hit) AS cache_hits, count(*) FILTER (kind = 'retrieval' AND NOT hit) AS cache_misses, CAST(coalesce(sum(latency_ms) FILTER (kind = 'embedding'), 0) AS BIGINT) AS embedding_latency_ms, CAST(coalesce(sum(latency_ms) FILTER (kind = 'ranking'), 0) AS BIGINT) AS ranking_latency_ms FROM l)"


def request_log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "purchase", "compression").when(F.col("event_type") == "click", "embedding").otherwise("ranking")
    return read(spark, sf_dir, "events").select(kind.alias("kind"), F.col("user_id").alias("tokens"), (F.col("user_id") % 7).alias("saved"), (F.col("event_id") % 100).alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("hit"))


@query(f"{USAGE} SELECT retrieved_tokens, compressed_tokens, saved_tokens, latency_ms, cache_hits, cache_misses, embedding_latency_ms, ranking_latency_ms FROM u")
def retrieval_metrics(spark, sf_dir):
    return tables.usage(request_log(spark, sf_dir)).drop("cache_hit_ratio")


@query(f"{USAGE} SELECT round(coalesce(cache_hits / nullif(cache_hits + cache_misses, 0), 0), 6) AS cache_hit_ratio FROM u")
def cache_hit_ratio(spark, sf_dir):
    return tables.usage(request_log(spark, sf_dir)).select(rounded("cache_hit_ratio"))


@query(f"{USAGE}, s AS (SELECT unnest([{', '.join(f'''{{'ord': {2 * i}, 'line': '# TYPE snipspark_{n} {k}'}}, {{'ord': {2 * i + 1}, 'line': 'snipspark_{n} ' || ''' + ('''printf('%.4f', cache_hits / (cache_hits + cache_misses))''' if k == 'gauge' else n) + '}' for i, (n, k) in enumerate(tables.SERIES.items()))}]) AS x FROM u) SELECT x.ord AS ord, x.line AS line FROM s")
def prometheus_lines(spark, sf_dir):
    return tables.exposition(tables.usage(request_log(spark, sf_dir)))


# changes between snapshots: the stored state lacks some documents, has others changed and some that are gone
SNAPSHOTS = "n AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), o AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 3 <> 0)"


def snapshots(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    new = d.where("doc_id % 7 <> 0").select("path", T.fingerprint(F.col("text")).alias("hash"))
    old = d.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, T.fingerprint(F.concat("text", F.lit("x")))).otherwise(T.fingerprint(F.col("text"))).alias("hash"))
    return new, old


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("hash"))


@query(f"WITH {SNAPSHOTS} SELECT path, hash FROM n ANTI JOIN o USING (path, hash)")
def changed_files(spark, sf_dir):
    return tables.changed(*snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS} SELECT path FROM o ANTI JOIN n USING (path)")
def removed_files(spark, sf_dir):
    return tables.removed(*snapshots(spark, sf_dir)).select("path")


@query(f"WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM n ANTI JOIN o USING (path, hash)) AS indexed, (SELECT count(*) FROM n) - (SELECT count(*) FROM n ANTI JOIN o USING (path, hash)) AS skipped, (SELECT count(*) FROM o ANTI JOIN n USING (path)) AS removed, (SELECT count(*) FROM part) AS symbols")
def index_stats(spark, sf_dir):
    new, old = snapshots(spark, sf_dir)
    return tables.index_stats(new, tables.changed(new, old), tables.removed(new, old), read(spark, sf_dir, "part"))


@query(f"WITH {SNAPSHOTS} SELECT path, hash FROM o SEMI JOIN n USING (path, hash) UNION ALL SELECT path, hash FROM n ANTI JOIN o USING (path, hash)")
def merge_snapshot(spark, sf_dir):
    new, old = snapshots(spark, sf_dir)
    return tables.replace_by(old, tables.changed(new, old), tables.removed(new, old), "path")


# paths
PATHS = "w AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '/tests/a.py' WHEN 2 THEN '.test.JS' WHEN 3 THEN '.md' WHEN 4 THEN '/x.HPP' ELSE '' END AS path FROM pages)"


def page_paths(spark, sf_dir):
    tails = [".ts", "/tests/a.py", ".test.JS", ".md", "/x.HPP", ""]
    tail = F.element_at(F.array(*(F.lit(t) for t in tails)), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail).alias("path"))


@query(f"WITH {PATHS} SELECT page_id, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {' '.join(f'''WHEN '{e}' THEN '{lang}' ''' for lang, es in T.LANGUAGES.items() for e in es)} ELSE 'unknown' END AS language FROM w")
def language_detect(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", T.language_of(F.col("path")).alias("language"))


@query(f"WITH {PATHS}, t AS (SELECT *, contains(lower(path), '/test/') OR contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/') OR regexp_matches(lower(path), '\\.(test|spec)\\.[a-z]+$') AS test FROM w) SELECT page_id, CASE WHEN test THEN 'test' WHEN ends_with(path, '.md') THEN 'doc' ELSE 'code' END AS kind, ends_with(lower(path), '.md') OR ends_with(lower(path), '.rst') OR contains(lower(path), '/docs/') AS is_doc FROM t")
def path_classify(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", T.snippet_kind(F.col("path")).alias("kind"), T.is_doc(F.col("path")).alias("is_doc"))


# evaluation and health
WINDOWS = "unnest(list_transform(range(1, greatest(len(ws) - 6, 0) + 1), lambda i: array_to_string(ws[i:i + 6], ' ')))"


@query(f"WITH {BM25}, x AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM m) WHERE r <= 10), g AS (SELECT DISTINCT query_id, doc_id FROM (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '[ \\n]+')[1:7], ' ') AS head FROM benchmark) JOIN (SELECT doc_id, {WINDOWS} AS head FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS ws FROM documents)) USING (head)) SELECT query_id, count(*) AS expected, count(x.doc_id) AS hit, round(count(x.doc_id) / count(*), 6) AS recall FROM g LEFT JOIN x USING (query_id, doc_id) GROUP BY query_id")
def benchmark_recall(spark, sf_dir):
    """How many of the documents that quote an item's first seven words are among its best ten."""
    words_of = lambda df, key: df.select(key, F.split("text", r"[ \n]+").alias("ws"))
    heads = words_of(asked(spark, sf_dir), "query_id").select("query_id", F.array_join(F.slice("ws", 1, 7), " ").alias("head"))
    runs = F.transform(F.sequence(F.lit(1), F.size("ws") - 6), lambda i: F.array_join(F.slice("ws", i, 7), " "))
    quotes = words_of(read(spark, sf_dir, "documents"), "doc_id").where("size(ws) >= 7").select("doc_id", F.explode(runs).alias("head"))
    truth = quotes.join(search.small(heads), "head").select("query_id", "doc_id")
    return tables.recall_of(truth, bm25_topk(spark, sf_dir), "query_id", "doc_id").select("query_id", "expected", "hit", rounded("recall"))


@query("SELECT (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM embeddings) > 0 AND (SELECT count(*) FROM documents WHERE text IS NULL) = 0 AS healthy, CAST(0 AS BIGINT) AS failed")
def health_check(spark, sf_dir):
    docs, vectors = read(spark, sf_dir, "documents", "embeddings")
    check = lambda df, name, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), "ok")
    return tables.health(check(docs, "documents", F.count("*") > 0).unionByName(check(vectors, "vectors", F.count("*") > 0)).unionByName(check(docs, "texts", F.count_if(F.col("text").isNull()) == 0)))


@query(f"""{HYBRID}, x AS (SELECT h.query_id, d.doc_id, d.source, d.text, h.score FROM h JOIN documents d USING (doc_id) WHERE rank <= 30 AND rank <= 20),
 y AS (SELECT *, round(score * 0.35 + CASE WHEN source = 'src' || query_id % 20 THEN 0.1 ELSE 0 END + ln(1 + CAST(doc_id % 5 AS DOUBLE)) * 0.05, 6) AS total, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM y)
 SELECT query_id, doc_id, rank, total AS score, CAST(run AS BIGINT) AS run FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM z) WHERE run <= 4000""")
def context_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = hybrid_search(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("semantic")).join(docs.select("doc_id", F.col("source").alias("file_path"), "text"), "doc_id")
    none = F.lit(None)
    c = found.withColumns({"open_files": F.array(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))), "recent_edits": none.cast("array<string>"), "git_diff": none.cast("string"), "current_file": none.cast("string"), "cursor_line": none.cast("int"), "start_line": F.lit(0), "distance": none.cast("int"), "in_degree": F.col("doc_id") % 5, "indexed_at_ms": none.cast("long")})
    ranked = ranking.rank(c, "query_id", "doc_id", AS_OF).withColumn("score", F.round("score", 6)).drop("rank")
    best = search.top_k(ranked, "query_id", "score", "doc_id", 20).withColumn("tokens", T.estimated_tokens(F.col("text")))
    return budget.fill(best, "query_id", 4000, few=True).select("query_id", "doc_id", "rank", "score", "run")
