"""Keyed tables: upserts, changes between snapshots, the memory of notes, expiry, usage metrics, symbol lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Categories of the memory.
CATEGORIES = ("project_summary", "decision", "convention", "retrieval", "conversation", "note")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't new, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def changed(found: DataFrame, stored: DataFrame, key: str = "path", digest: str = "hash", force: bool = False) -> DataFrame:
    """Rows that are new or whose digest differs; with force all."""
    return found if force else found.join(stored.select(key, digest), [key, digest], "left_anti")


def removed(found: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(found.select(key), key, "left_anti")


def replace_by(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A child table after its parents in `new` and `gone` (column key) were replaced and removed."""
    touched = new.select(key).union(gone.select(key)).distinct()
    return old.join(touched, key, "left_anti").unionByName(new)


def index_stats(found: DataFrame, fresh: DataFrame, gone: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: indexed, skipped, removed, symbols; one aggregation over all four."""
    tagged = [df.select(F.lit(tag).alias("tag")) for df, tag in ((found, "found"), (fresh, "fresh"), (gone, "gone"), (symbols, "symbol"))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    n = lambda tag: F.count_if(F.col("tag") == tag)
    return rows.agg(n("fresh").alias("indexed"), (n("found") - n("fresh")).alias("skipped"), n("gone").alias("removed"), n("symbol").alias("symbols"))


def remember(entries: DataFrame) -> DataFrame:
    """The memory after all writes (category, key, content, at): the last content, with the first and last time. Of writes at one time the greatest content counts."""
    return entries.groupBy("category", "key").agg(F.max_by("content", F.struct("at", "content")).alias("content"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def recall(memory: DataFrame, category: str | None = None, key: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first."""
    if category is not None:
        memory = memory.where(F.col("category") == category)
    if key is not None:
        memory = memory.where(F.col("key") == key)
    return memory.orderBy(F.col("updated_at").desc(), "category", "key").limit(limit)


def forget(memory: DataFrame, category: str, key: str | None = None) -> DataFrame:
    hit = (F.col("category") == category) & (F.lit(True) if key is None else F.col("key") == key)
    return memory.where(~F.coalesce(hit, F.lit(False)))


def live(entries: DataFrame, now) -> DataFrame:
    """Entries that haven't expired."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def hit_ratio(hits, misses):
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def usage(log: DataFrame) -> DataFrame:
    """One row of counters from a request log (kind, tokens, saved, latency_ms, hit); an entry below 0 counts as 0."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.greatest(F.col(c), F.lit(0)))), F.lit(0))
    hits, misses = (F.count_if((F.col("kind") == "retrieval") & (F.col("hit") == v)) for v in (True, False))
    return log.agg(
        of("retrieval", "tokens").alias("retrieved_tokens"), of("compression", "tokens").alias("compressed_tokens"), of("compression", "saved").alias("saved_tokens"), of("retrieval", "latency_ms").alias("latency_ms"),
        hits.alias("cache_hits"), misses.alias("cache_misses"), of("embedding", "latency_ms").alias("embedding_latency_ms"), of("ranking", "latency_ms").alias("ranking_latency_ms"),
    ).withColumn("cache_hit_ratio", hit_ratio(F.col("cache_hits"), F.col("cache_misses")))


SERIES = {"retrieved_tokens": "counter", "compressed_tokens": "counter", "saved_tokens": "counter", "latency_ms": "counter", "cache_hit_ratio": "gauge", "embedding_latency_ms": "counter", "ranking_latency_ms": "counter"}


def exposition(counters: DataFrame, prefix: str = "snipspark") -> DataFrame:
    """The counters as lines of the text exposition format: (ord, line), two for each series."""
    pairs = []
    for i, (name, kind) in enumerate(SERIES.items()):
        value = F.format_string("%.4f", F.col(name).cast("double")) if kind == "gauge" else F.col(name).cast("long").cast("string")
        pairs += [F.struct(F.lit(2 * i).alias("ord"), F.lit(f"# TYPE {prefix}_{name} {kind}").alias("line")), F.struct(F.lit(2 * i + 1).alias("ord"), F.concat(F.lit(f"{prefix}_{name} "), value).alias("line"))]
    return counters.select(F.inline(F.array(*pairs)))


def find_symbols(symbols: DataFrame, name: str | None = None, kind: str | None = None, file_path: str | None = None, language: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols whose name contains a text, ignoring case, of a kind, file and language; a page by name and id."""
    if name:
        symbols = symbols.where(F.lower("name").contains(name.lower()))
    for column, value in (("kind", kind), ("file_path", file_path), ("language", language)):
        if value:
            symbols = symbols.where(F.col(column) == value)
    return symbols.orderBy("name", "id").offset(offset).limit(limit)


def references_of(refs: DataFrame, symbol_id: str) -> DataFrame:
    """References from a symbol or to it (refs with the column to_symbol_id)."""
    return refs.where((F.col("from_symbol_id") == symbol_id) | (F.col("to_symbol_id") == symbol_id))


def references_of_file(refs: DataFrame, symbols: DataFrame, file_path: str) -> DataFrame:
    """References that stand in a file or come from a symbol of it."""
    own = symbols.where(F.col("file_path") == file_path).select(F.col("id").alias("from_symbol_id")).distinct().withColumn("own", F.lit(True))
    return refs.join(own, "from_symbol_id", "left").where((F.col("file_path") == file_path) | F.col("own")).drop("own")


def health(checks: DataFrame) -> DataFrame:
    """(healthy, failed) of rows (name, ok)."""
    return checks.agg(F.bool_and("ok").alias("healthy"), F.count_if(~F.col("ok")).alias("failed"))


def recall_of(expected: DataFrame, found: DataFrame, query: str, item: str) -> DataFrame:
    """(query, expected, hit, recall)."""
    both = expected.select(query, item).distinct().join(found.select(query, item).distinct().withColumn("hit", F.lit(1)), [query, item], "left")
    return both.groupBy(query).agg(F.count("*").alias("expected"), F.count("hit").alias("hit"), (F.count("hit") / F.count("*")).alias("recall"))
