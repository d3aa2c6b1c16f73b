"""Retrieval for many queries at once: binary-term BM25, vector top-k, weighted fusion. Every result is keyed by query.

Texts become tokens once (`tokens`, or the engine's stored table of them); BM25, embeddings and name overlap read those."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedders import LOCAL
from ..functions.text import search_terms, terms_of_texts
from ..functions.vectors import DIMENSIONS, cosine, hash_vectors
from ..sources.scratch import stored

#: Saturation and length normalisation of BM25.
K1, B = 1.2, 0.75
#: Sides of at most so many rows are broadcast; so many query vectors are compared at once (some 50 MB).
SMALL, BLOCK = 100_000, 16_384
#: Pairs of vectors that a task compares at once (some 32 MB a table of them).
PAIRS = 1 << 22
#: Bytes of an Arrow batch between the JVM and a Python worker, where the session sets none.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
#: Input under so many bytes a core may be a single row group, and is dealt over all cores before it is tokenised.
SPLIT = 32 << 20


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """With a broadcast hint if a count of its rows, cut off at the bound, allows it; else Spark joins by shuffling.
    Only for sides that are cheap to count, such as those made of the queries alone."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores where the input is small for them; large inputs have splits enough and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT else df


def tokens(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep, ts, dl): the distinct terms of each text, in order, and their number."""
    if docs.sparkSession.conf.get(BATCH_KEY, None) is None:  # a batch of 10,000 texts or lists of terms is some hundred MB of Python objects
        docs.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    t = spread(docs.select(key, *keep, F.col(text).alias("__text"))).select(key, *keep, terms_of_texts(F.col("__text")).alias("ts"))
    return t.withColumn("dl", F.size("ts"))


def held(df: DataFrame) -> DataFrame:
    """Kept for several readers; a lost executor's part is made again from its input."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def postings(tokens: DataFrame, *columns: str) -> DataFrame:
    """(columns, term): a row for each term of each text. An outer explode, as Spark guards an inner one by a filter that makes the terms a second time."""
    return tokens.select(*columns, F.explode_outer("ts").alias("term")).where("term is not null")


def asked_terms(queries: DataFrame, query: str, text: str, *keep: str) -> DataFrame:
    return postings(queries.select(query, *keep, search_terms(F.col(text)).alias("ts")), query, *keep)


def bm25(tokens: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "query_id", query_text: str = "text", where: Column | None = None, by: str | None = None) -> DataFrame:
    """(query, key, bm25) of all matches. Frequencies and lengths are those of all texts; `where` only restricts the
    matches. With `by` (a column of both sides) a query sees the texts of its group alone, with that group's numbers;
    nothing grows with the number of groups but the rows.

    Only terms that are asked for are joined: their postings are found against the queries' terms, broadcast when a
    count of those allows it, and frequencies are counted before anything is shuffled."""
    group = [by] if by else []
    asked = asked_terms(queries, query, query_text, *group)
    fits = asked.limit(SMALL + 1).count() <= SMALL
    hint = F.broadcast if fits else lambda df: df
    shape = tokens.groupBy(*group).agg(F.count("*").alias("n"), F.avg("dl").alias("a"))
    allowed = where if where is not None else F.lit(True)
    post = postings(tokens.withColumn("allowed", allowed), key, "dl", "allowed", *group).join(hint(asked.select("term", *group).distinct()), ["term", *group])
    df = post.groupBy("term", *group).agg(F.count("*").alias("df"))
    # no more rows than asked for; the shape is one row, or one for each group asked for
    counted = asked.join(df, ["term", *group])
    counted = counted.join(shape, group) if by else counted.join(F.broadcast(shape))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = counted.select(query, *group, "term", (idf * (K1 + 1)).alias("idf"), F.greatest("a", F.lit(1.0)).alias("a"))
    score = F.col("idf") / (1 + K1 * (1 - B + B * F.col("dl") / F.col("a")))
    return post.where("allowed").join(hint(weighted), ["term", *group]).groupBy(query, key).agg(F.sum(score).alias("bm25"))


def top_k(scored: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each query with their rank; ties by key. Spark keeps only k rows a task and query before it shuffles."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best keys of each query among the blocks seen; ties by key."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor, self.held, self.count = k, np.full(n_queries, -np.inf), [], 0

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        row, q = np.nonzero(scores >= self.floor)
        self.held.append((q, scores[row, q], keys.take(pa.array(row))))
        self.count += len(q)
        if self.count > max(4 * self.k * len(self.floor), 1 << 20):
            self.prune()

    def prune(self) -> tuple:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), None
        q, s = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        keys = pa.concat_arrays([h[2] for h in self.held])
        order = np.lexsort((pc.rank(keys).to_numpy(), -s, q))
        at = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
        order = order[at < self.k]
        q, s, keys = q[order], s[order], keys.take(pa.array(order))
        full = np.flatnonzero(np.bincount(q, minlength=len(self.floor)) >= self.k)
        ends = np.searchsorted(q, full, "right") - 1
        self.floor[full] = s[ends]
        self.held, self.count = [(q, s, keys)], len(q)
        return q, s, keys


def matrix(column) -> np.ndarray:
    """Rows of equal length at length 1; other rows, and those without direction, are zeros. The first row's length counts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column)
    flat = column.flatten()
    if len(column) and not column.null_count and not flat.null_count and pc.all(pc.equal(sizes, sizes[0])).as_py():
        rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    rows = [np.asarray(r if r is not None else [], np.float64) for r in column.to_pylist()]
    out = np.zeros((len(rows), len(rows[0]) if rows else 0))
    for i, r in enumerate(rows):
        size = np.sqrt((r * r).sum())
        if len(r) == out.shape[1] and size > 0:
            out[i] = r / size
    return out


def cosines(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The cosine of each row with each of the right; 0 where lengths differ or there is no direction."""
    a, b = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (left, right))
    sizes = np.intersect1d(a[a > 0], b[b > 0])
    if len(sizes) == 1 and (a == sizes[0]).all() and (b == sizes[0]).all():
        return matrix(left) @ matrix(right).T
    out = np.zeros((len(a), len(b)))
    for n in sizes:
        i, j = np.flatnonzero(a == n), np.flatnonzero(b == n)
        out[np.ix_(i, j)] = matrix(left.take(pa.array(i))) @ matrix(right.take(pa.array(j))).T
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits


def rounded(x: Column, digits: int) -> Column:
    """`half_up` as a column: halves go by the double itself, where Spark's round goes by its shortest decimal form."""
    y = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int, vector: str = "vector", digits: int = 6) -> DataFrame:
    """(query, key, cosine, rank): the k nearest vectors of each query of a stated set (columns query, vector), by
    rounded cosine, ties by key; vectors of another length are at 0.

    Query vectors go to the tasks in blocks of at most BLOCK; each task multiplies matrices and keeps its k best of each
    query, so neither pairs nor places are shuffled."""
    kind, asked = vectors.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    blocks = -(-queries.count() // BLOCK) or 1
    out = None
    for block in range(blocks):
        rows = queries.select(query, vector).where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block).orderBy(query).toArrow()
        names, wanted = rows.column(query).combine_chunks(), matrix(rows.column(vector))
        shared = queries.sparkSession.sparkContext.broadcast((names, wanted))

        def stage(batches, shared=shared):
            names, wanted = shared.value
            best = Best(len(names), k)
            for b in batches:
                step = max(1, PAIRS // max(len(names), 1))
                for lo in range(0, b.num_rows if len(names) else 0, step):
                    part = b.slice(lo, step)
                    v = matrix(part.column(vector))
                    best.add(half_up(v @ wanted.T, digits) if v.shape[1] == wanted.shape[1] else np.zeros((len(v), len(names))), part.column(key))
            q, s, keys = best.prune()
            if len(q):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys, pa.array(s)], [query, key, "cosine"])

        near = vectors.select(key, vector).mapInArrow(stage, f"{query} {asked}, {key} {kind}, cosine double")
        out = near if out is None else out.unionByName(near)
    return top_k(out, query, "cosine", key, k)


def nearest_within(vectors: DataFrame, queries: DataFrame, key: str, query: str, by: str, k: int, vector: str = "vector", digits: int = 6) -> DataFrame:
    """`nearest` among the vectors of each query's own group (column `by` of both sides, such as a file): blocks of a group's vectors
    meet blocks of its queries."""
    from .vector_index import in_blocks  # which builds on this module

    grouped = lambda df, c: df.where(F.col(by).isNotNull()).select(c, F.col(by).alias("cell"), vector)
    return in_blocks(grouped(vectors, key), grouped(queries, query), key, query, k, vector, digits).select(query, key, "cosine", "rank")


def name_overlap(names: DataFrame, queries: DataFrame, key: str, name: str, query: str, query_text: str, by: str | None = None) -> DataFrame:
    """(query, key, overlap): the share of a query's terms that are terms of a name; with `by` among the names of the query's group."""
    group = [by] if by else []
    asked = queries.select(query, *group, search_terms(F.col(query_text)).alias("ts")).withColumn("n", F.size("ts"))
    named = postings(names.select(key, *group, search_terms(F.col(name)).alias("ts")), key, *group)
    return named.join(small(postings(asked, query, "n", *group)), ["term", *group]).groupBy(query, key, "n").agg((F.count("*") / F.col("n")).alias("overlap")).drop("n")


def fused(query: str, key: str, keyword: DataFrame, vector: DataFrame, overlap: DataFrame | None = None, weights: tuple[float, float] = LOCAL) -> DataFrame:
    """(query, key, score): keyword scores over their largest (1 at least), cosines and name overlaps, weighted and added; a row in any leg counts."""
    ws, wk = weights
    best = F.greatest(F.max("bm25").over(Window.partitionBy(query)), F.lit(1.0))
    legs = keyword.select(query, key, (F.col("bm25") / best * wk).alias("part")).unionByName(vector.select(query, key, (F.col("cosine") * ws).alias("part")))
    if overlap is not None:
        legs = legs.unionByName(overlap.select(query, key, (F.col("overlap") * wk).alias("part")))
    return legs.groupBy(query, key).agg(F.sum("part").alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", name: str | None = None, query: str = "query_id", query_text: str = "text", weights: tuple[float, float] = LOCAL, language: str | None = None, strict: bool = False, digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the fused top k. `language` restricts the keyword leg alone, with `strict` all legs.
    Cosines and scores are rounded before they are ranked, so that the order of additions decides no tie."""
    from .keyword import Keyword, with_others  # which builds on this module

    only = F.col("lang") == language if language else None
    kept = held(tokens(docs, key, text, *(["lang"] if language else [])))
    scope = kept.where(only) if language and strict else kept
    wanted = hash_vectors(queries.select(query, search_terms(F.col(query_text)).alias("ts")), query, DIMENSIONS)
    vector = nearest(hash_vectors(scope, key, DIMENSIONS), wanted, key, query, 2 * k, digits=digits)
    overlap = name_overlap(docs.where(only) if language and strict else docs, queries, key, name, query, query_text) if name else None
    index = Keyword(kept, queries, key, query, query_text, only)
    vector = stored(vector.select(query, key, "cosine"))
    keyword = with_others(index, k, vector, *([overlap] if overlap is not None else []))
    if only is not None:
        keyword = keyword.join(kept.where(only).select(key), key, "left_semi")
    return top_k(fused(query, key, keyword, vector, overlap, weights).withColumn("score", rounded(F.col("score"), digits)), query, "score", key, k)
