"""The engine: index a source tree, search, assemble context for requests, compress, budget, remember, report.

Every read method returns a DataFrame and takes requests in batches; the plan for one request and for ten thousand is
the same."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embedders import HashEmbedder
from ..functions.text import estimated_tokens, joined_parts
from ..operators import budget, compress, graph, ranking, search, tables
from ..operators.keyword import Keyword, with_others
from ..sources import files, parsing
from ..sources.scratch import stored
from ..sources.store import SCHEMAS, Store

REQUEST = "query_id long, task string, current_file string, cursor_line int, open_files array<string>, recent_edits array<string>, git_diff string"


class EngineError(Exception):
    """Base of the engine's errors."""


class InvalidRequest(EngineError):
    """A request that breaks a rule of its fields."""


def positive(name: str, value) -> None:
    if value is not None and (not isinstance(value, int) or value <= 0):
        raise InvalidRequest(f"{name} must be a positive whole number")


def filled(name: str, value: str) -> None:
    if not isinstance(value, str) or not value:
        raise InvalidRequest(f"{name} must not be empty")


#: Errors that a run of the index returns; results of the search that the ranking starts from; characters of a task's key.
ERRORS, FOUND, KEY = 100, 30, 100


@dataclass
class Engine:
    """`embedder` makes the vectors (see functions/embedders.py), `count` a column of token counts from one of texts."""

    spark: SparkSession
    root: str
    rules: list[str] | None = None
    documents: bool = True
    embedder: object = field(default_factory=HashEmbedder)
    count: Callable[[Column], Column] = estimated_tokens

    def __post_init__(self):
        self.store, self.watched = Store(self.spark, self.root), []

    def _watch(self, kind: str, df: DataFrame, tokens: Column, saved: Column | None = None) -> DataFrame:
        """The rows, which when they are first made tell `metrics` their tokens and when the last of them was there."""
        seen, clock = Observation(), F.expr("reflect('java.lang.System', 'currentTimeMillis')").cast("long")
        self.watched.append((kind, seen, int(time.time() * 1000)))
        return df.observe(seen, F.sum(tokens).alias("tokens"), F.sum(F.lit(0) if saved is None else saved).alias("saved"), F.max(clock).alias("end"))

    # index
    def index(self, source: str, force: bool = False, now_ms: int | None = None) -> dict:
        """Indexes what changed under a folder; children, graph and vectors of changed and removed files are replaced, in
        one commit that writes the buckets of these files alone, and of those whose links and edges may change with them.
        Returns counts, the number of files that couldn't be parsed, and at most ERRORS of their errors."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        found = files.scan(self.spark, source, self.rules, self.documents)
        old = self.store.table("files")
        fresh, gone = tables.changed(found, old, force=force).persist(), tables.removed(found, old).persist()
        parsed = parsing.parse(fresh).persist()
        stats = tables.index_stats(found, fresh, gone, parsing.table(parsed, "symbols")).first().asDict()
        bad = parsed.where("error is not null")
        errors = [(r["path"], r["error"]) for r in bad.select("path", "error").limit(ERRORS).collect()]
        if stats["indexed"] or stats["removed"]:
            touched = stored(fresh.select(F.col("path").alias("file_path")).union(gone.select("path")).distinct())
            # what is made from the change is written once, as the rest reads it again and again
            new = {name: stored(parsing.table(parsed, name)) for name in ("symbols", "imports", "refs", "chunks")}
            now = {name: self.store.table(name).join(touched, "file_path", "left_anti").unionByName(new[name]) for name in ("symbols", "imports", "refs")}
            files_now = old.join(touched, F.col("path") == F.col("file_path"), "left_anti").select("path").unionByName(fresh.select("path"))
            listed = fresh.drop("content").withColumn("indexed_at_ms", F.lit(now_ms))
            made = search.held(search.tokens(new["chunks"].withColumnRenamed("id", "chunk_id"), "chunk_id", "content", "content", "file_path", "language", "symbol_kind", "symbol_name"))
            vectors = self.embedder.embed(made, "chunk_id", "content").join(made.select("chunk_id", "file_path"), "chunk_id").withColumn("provider", F.lit(self.embedder.name))
            # links and edges change in files that name a symbol of a touched file, before or after, or may import such a file
            named = self.store.table("symbols").join(touched, "file_path", "left_semi").select("name").union(new["symbols"].select("name")).distinct()
            affected = stored(graph.affected(touched, named, now["imports"], now["refs"]))
            imports, refs = (stored(now[name].join(affected, "file_path", "left_semi")) for name in ("imports", "refs"))
            links = graph.resolve_names(refs.select(F.col("id").alias("ref_id"), "file_path", F.col("to_name").alias("name")), now["symbols"])
            links = links.join(refs.select(F.col("id").alias("ref_id"), "file_path"), "ref_id")
            edges = graph.edges(files_now, now["symbols"], imports, refs, of=affected)
            rows = {"files": listed, "terms": made.drop("content"), "vectors": vectors, "nodes": graph.nodes(listed, new["symbols"]), **new}
            began = time.time()
            self.store.commit(replaced={name: (df, touched) for name, df in rows.items()} | {"links": (links, affected), "edges": (edges, affected)})
            # the vectors are made in the commit
            self.log(self.spark.createDataFrame([("embedding", 0, 0, int((time.time() - began) * 1000), False)], SCHEMAS["log"]))
            made.unpersist()
        stats |= {"failed": bad.count(), "errors": errors}
        for df in (fresh, gone, parsed):
            df.unpersist()
        return stats

    # search
    def search(self, queries: DataFrame, limit: int = 20, language: str | None = None, kinds: list[str] | None = None, file_path: str | None = None, strict: bool = False) -> DataFrame:
        """(query_id, rank, score, chunk_id, symbol_id, file_path, content, ord, start_line, end_line) for queries (query_id,
        text and, if they like, file_path: the one file to search in). language restricts the keyword leg only, unless strict."""
        positive("limit", limit)
        if file_path:
            queries = queries.withColumn("file_path", F.lit(file_path))
        only = F.col("language") == language if language else None
        if "file_path" not in queries.columns:
            best = self._best(queries, limit, only, kinds, strict, None)
        else:
            inside = self._best(queries.where("file_path is not null"), limit, only, kinds, strict, "file_path")
            best = inside if file_path else inside.unionByName(self._best(queries.where("file_path is null").drop("file_path"), limit, only, kinds, strict, None))
        rows = self.store.table("chunks").select(F.col("id").alias("chunk_id"), "symbol_id", "file_path", "content", "ord", "start_line", "end_line")
        return best.join(rows, "chunk_id")

    def _best(self, queries: DataFrame, limit: int, only, kinds, strict: bool, by: str | None) -> DataFrame:
        """(query_id, chunk_id, score, rank), with `by` within each query's own file: the file is a key of the joins, so many files are one plan."""
        terms = self.store.table("terms")
        if kinds:
            terms = terms.where(F.col("symbol_kind").isin(kinds))
        scope = terms.where(only) if only is not None and strict else terms
        vectors = self.store.table("vectors")
        if kinds or (only is not None and strict):
            vectors = vectors.join(scope.select("chunk_id"), "chunk_id", "left_semi")
        wanted = self.embedder.embed(queries, "query_id", "text")
        if by:
            cosines = search.nearest_within(vectors, wanted.join(queries.select("query_id", by), "query_id"), "chunk_id", "query_id", by, 2 * limit)
        else:
            cosines = search.nearest(vectors, wanted, "chunk_id", "query_id", 2 * limit)
        named = search.name_overlap(scope.where("symbol_name is not null"), queries, "chunk_id", "symbol_name", "query_id", "text", by)
        if by:
            keyword = search.bm25(terms, queries, "chunk_id", where=only, by=by)
        else:
            cosines, named = stored(cosines.drop("rank")), stored(named)
            keyword = with_others(Keyword(terms, queries, "chunk_id", where=only), limit, cosines, named)
            if only is not None:
                keyword = keyword.join(terms.where(only).select("chunk_id"), "chunk_id", "left_semi")
        best = search.fused("query_id", "chunk_id", keyword, cosines, named, self.embedder.weights).withColumn("score", F.round("score", 9))
        return search.top_k(best, "query_id", "score", "chunk_id", limit)

    def find(self, text: str, limit: int = 20) -> DataFrame:
        """(kind, rank, payload) for one text: symbols whose name holds it, then what the search finds, as JSON."""
        query = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        named = self.symbols(name=text, limit=limit)
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "id")))
        found = self.search(query, max(1, limit // 2)).drop("query_id")
        pack = lambda df, kind: df.select(F.lit(kind).alias("kind"), "rank", F.to_json(F.struct(*(c for c in df.columns if c != "rank"))).alias("payload"))
        return pack(named, "symbol").unionByName(pack(found, "chunk"))

    # context
    def context(self, requests: DataFrame, max_tokens: int | None = None, limit: int | None = None, as_of_ms: int | None = None, weights: dict | None = None) -> DataFrame:
        """The snippets chosen for each request (REQUEST): rank, score, scores, tokens, run, file_path, lines, content.
        Without max_tokens the budget adapts to the collection and the scores. Token counts are the engine's counter's."""
        positive("max_tokens", max_tokens)
        positive("limit", limit)
        as_of_ms = int(time.time() * 1000) if as_of_ms is None else as_of_ms
        chunks, edges = self.store.table("chunks"), self.store.table("edges")
        total = chunks.count()
        note = tables.recall(self.store.table("memory"), "project_summary", "default", 1).select(F.col("content").alias("note"))
        asked = requests.join(F.broadcast(note), how="left").select("query_id", F.col("current_file").alias("file_path"), joined_parts(F.col("task"), F.coalesce("note", F.lit(""))).alias("text"))
        found = stored(self.search(asked, FOUND))
        more = graph.expand(found, edges, chunks.withColumnRenamed("id", "chunk_id"), total)
        first = 2 if total <= 50 else 3
        w = Window.partitionBy("file_path").orderBy("ord", "id")
        heads = chunks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first).select(F.col("id").alias("chunk_id"), F.col("file_path").alias("current_file"))
        more = more.unionByName(requests.select("query_id", "current_file").join(heads, "current_file").select("query_id", "chunk_id")).distinct()
        both = ranking.candidate_union(found.select("query_id", "chunk_id", F.col("score").alias("semantic")), more, "query_id", "chunk_id")
        rows = both.join(chunks.select(F.col("id").alias("chunk_id"), "symbol_id", "file_path", "content", "start_line", "end_line"), "chunk_id").join(requests, "query_id")
        seeds = requests.where("current_file is not null").select("query_id", graph.file_node(F.col("current_file")).alias("seed"))
        reached = graph.neighbours(edges, seeds.select("seed"), 3, None, 100).join(seeds, "seed").select("query_id", "node_id", "distance")
        placed = ranking.distances(rows, reached, "query_id")
        placed = placed.join(graph.in_degree(edges).withColumnRenamed("node_id", "symbol_id"), "symbol_id", "left").join(self.store.table("files").select(F.col("path").alias("file_path"), "indexed_at_ms"), "file_path", "left")
        ranked = ranking.rank(placed, "query_id", "chunk_id", as_of_ms, weights or ranking.WEIGHTS).withColumn("tokens", self.count(F.col("content")))
        chosen = budget.fill(ranked, "query_id", max_tokens, few=True) if max_tokens else budget.adaptive(ranked, "query_id", total, few=True)
        if limit:
            chosen = chosen.where(F.col("rank") <= limit)
        chosen = chosen.select("query_id", "rank", "chunk_id", "symbol_id", "file_path", "start_line", "end_line", "content", "score", "scores", "tokens", "run")
        return self._watch("retrieval", chosen, F.col("tokens"))

    def record(self, requests: DataFrame, chosen: DataFrame, now_ms: int | None = None) -> None:
        """Notes what `context` chose for requests: a memory entry for each task (its first 100 characters are the key, the
        chosen files the content)."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        each = chosen.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("file_path")), ", ").alias("files"))
        done = requests.select("query_id", "task").join(each, "query_id", "left")
        notes = done.select(F.lit("retrieval").alias("category"), F.substring("task", 1, KEY).alias("key"), F.coalesce("files", F.lit("")).alias("content"), F.lit(now_ms).alias("at"))
        self.store.commit(replaced={"memory": self._remembered(notes)})

    # text
    def compress(self, texts: DataFrame, target: int | None = None) -> DataFrame:
        """texts (text) with the struct `result`."""
        positive("target", target)
        done = compress.compress(texts, "text", target, count=self.count)
        return self._watch("compression", done, F.col("result.compressed_tokens"), F.col("result.saved_tokens"))

    def budget(self, items: DataFrame, max_tokens: int) -> DataFrame:
        """The prefix of items (query_id, rank, content) that fits."""
        positive("max_tokens", max_tokens)
        return budget.fill(items.withColumn("tokens", self.count(F.col("content"))), "query_id", max_tokens)

    # lookups
    def symbols(self, **query) -> DataFrame:
        return tables.find_symbols(self.store.table("symbols"), **query)

    def file(self, path: str) -> DataFrame:
        filled("path", path)
        return self.store.table("files").where(F.col("path") == path)

    def by_id(self, table: str, id: str) -> DataFrame:
        """The symbol, chunk, import, reference or node of an id."""
        filled("id", id)
        return self.store.table(table).where(F.col("id") == id)

    def imports(self, file_path: str | None = None) -> DataFrame:
        every = self.store.table("imports")
        return every if file_path is None else every.where(F.col("file_path") == file_path)

    def references(self, symbol_id: str | None = None, file_path: str | None = None) -> DataFrame:
        """References with the symbol they name (to_symbol_id, null if unknown): all, or those from and to a symbol, or
        those that stand in a file or come from a symbol of it."""
        every = self.store.table("refs").join(self.store.table("links").select(F.col("ref_id").alias("id"), F.col("symbol_id").alias("to_symbol_id")), "id", "left")
        if file_path is not None:
            every = tables.references_of_file(every, self.store.table("symbols"), file_path)
        return every if symbol_id is None else tables.references_of(every, symbol_id)

    def neighbours(self, node: str, depth: int = 1, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
        filled("node", node)
        positive("depth", depth)
        seeds = self.spark.createDataFrame([(node,)], "seed string")
        nodes = self.store.table("nodes")
        return graph.neighbours(self.store.table("edges"), seeds, depth, kinds, limit, nodes).join(nodes, F.col("node_id") == F.col("id")).drop("id", "seed")

    def docs(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Search among documents alone; the restriction comes before the top k."""
        return self.search(queries, limit, kinds=["section"])

    # memory
    def remember(self, category: str, key: str, content: str, now_ms: int | None = None) -> None:
        filled("key", key)
        if category not in tables.CATEGORIES:
            raise InvalidRequest(f"unknown category {category}")
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        entry = self.spark.createDataFrame([(category, key, content, now_ms)], "category string, key string, content string, at long")
        self.store.commit(replaced={"memory": self._remembered(entry)})

    def _remembered(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The memory of the keys that entries write to, after them, and these keys. An old row is its first and its last write."""
        keys = entries.select("key").distinct()
        old = self.store.table("memory").join(keys, "key", "left_semi")
        writes = lambda at: old.select("category", "key", "content", F.col(at).alias("at"))
        return tables.remember(writes("created_at").unionByName(writes("updated_at")).unionByName(entries)), keys

    def recall(self, category: str | None = None, key: str | None = None, limit: int = 100) -> DataFrame:
        positive("limit", limit)
        return tables.recall(self.store.table("memory"), category, key, limit)

    def forget(self, category: str, key: str | None = None) -> None:
        rest = tables.forget(self.store.table("memory"), category, key)
        if key is None:
            self.store.commit(whole={"memory": rest})
        else:
            self.store.commit(replaced={"memory": (rest.where(F.col("key") == key), self.spark.createDataFrame([(key,)], "key string"))})

    def project_summary(self) -> tuple[str | None, DataFrame]:
        """The remembered summary and the first five symbols by name."""
        note = self.recall("project_summary", "default", 1).head()
        return note["content"] if note else None, self.symbols(limit=5)

    # state
    def log(self, entries: DataFrame) -> None:
        self.store.commit(appended={"log": entries})

    def metrics(self) -> DataFrame:
        """One row of counters over the log, to which what `context`, `compress` and `index` did since is added first. A request's
        latency is the time from the call to its last row; contexts that were never read count for nothing."""
        done = [w for w in self.watched if w[1]._jo is not None and w[1]._jo.future().isCompleted()]
        if done:
            self.watched = [w for w in self.watched if w not in done]
            rows = [(kind, int(m["tokens"] or 0), int(m["saved"] or 0), max(0, (m["end"] or start) - start), False) for kind, seen, start in done for m in [seen.get]]
            self.log(self.spark.createDataFrame(rows, SCHEMAS["log"]))
        return tables.usage(self.store.table("log"))

    def doctor(self) -> dict:
        """Whether there are files, chunks and a graph, and a vector for every chunk with terms."""
        n = {t: self.store.table(t).count() for t in ("files", "chunks", "nodes")}
        bare = self.store.table("terms").where("dl > 0").join(self.store.table("vectors"), "chunk_id", "left_anti")
        checks = {"storage": bool(self.store.versions()), "files": n["files"] > 0, "chunks": n["chunks"] > 0, "graph": n["nodes"] >= n["files"], "vectors": n["chunks"] > 0 and not bare.limit(1).count()}
        return {"healthy": all(checks.values()), "checks": checks}


def as_json(df: DataFrame) -> DataFrame:
    """One column `json`: each row as a JSON object, for sinks of text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
