"""Near-duplicate vectors of equal labels by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, thinned so that no two are alike and filled up by random
directions. A vector is described by its NEAR nearest pivots; near-copies share most of them. Two vectors that share at least SHARED of NEAR must, with pivots
in one order (rarest first), meet among the first NEAR - SHARED + 1 of both, so each vector enters that many inverted lists of
its label. In a list, shared pivots are counted, pairs with enough of them are verified by their cosine in double
precision. A pair is counted in the first list that both are in, so that no pair is counted twice or leaves a task: a
vector leaves with its number of links there and the root of its component there. Lists longer than a block are
cut into blocks, and each pair of blocks is a group of its own.

The index is approximate: pairs that share fewer pivots are missed (measured by `recall`); no link is ever made below the bound. The
sample is of at most 4 * MOST vectors; every vector is indexed. A group of many near-copies that aren't equal costs the square of its
size in comparisons, in blocks; equal vectors are one vector with a weight from the start.

Cases: rows whose vec_id, label or vector is null, and vectors that are empty, zero or hold null or non-finite components, link
with nothing (n_links 0, component_id = vec_id, kept). Shorter vectors count as padded by zeros. Rows that share a vec_id
are vectors of their own; equal rows link with each other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .decontaminate import sized
from .jaccard_join import components

COSINE = 0.98
#: Pivots that describe a vector, and those that candidates share at least.
NEAR, SHARED = 8, 4
#: Pivots: their number grows with the root of the rows, between these bounds; candidates alike beyond this cosine are thinned out.
LEAST, MOST, ALIKE = 128, 4096, 0.8
#: Vectors of one side of a comparison, and of the rows compared at once.
BLOCK, ROWS = 2048, 256


def as_matrix(column, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors of finite components, and those as a matrix of doubles, padded by zeros to `size`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    size = int(length.max(initial=0)) if size is None else size
    full = np.zeros((len(length), max(size, 1)))
    fits = place < size
    full[row[fits], place[fits]] = values[fits]
    return (length > 0) & np.isfinite(full).all(axis=1), full


def key_stage(size: int):
    """(vec_id, label, vector) to (vec_id, label, key, v) of the rows that may link; key is a 128-bit hash of label and vector."""

    def stage(batches):
        for b in batches:
            ok, x = as_matrix(b.column("vector"), size)
            ok &= x.any(axis=1)
            x = x + 0.0  # one zero
            with np.errstate(over="ignore", invalid="ignore"):
                small = x.astype(np.float32)
                exact = (small == x).all(axis=1)
            label = b.column("label").to_pylist()
            key, v = [], []
            for i in np.flatnonzero(ok):
                v.append((small if exact[i] else x)[i].tobytes())
                key.append(xxhash.xxh3_128_digest(f"{label[i]}\0".encode() + v[-1]))
            rows = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("label").take(rows), pa.array(key, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "label", "key", "v"])

    return stage


def units(blobs: list[bytes], size: int) -> np.ndarray:
    """The stored vectors at length 1."""
    x = np.empty((len(blobs), size))
    for row, b in zip(x, blobs):
        row[:] = np.frombuffer(b, np.float32 if len(b) == 4 * size else np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots_of(vectors: np.ndarray, wanted: int, size: int) -> np.ndarray:
    """Of the sample those that aren't alike, filled up by random directions."""
    chosen = np.empty((wanted, size))
    n = 0
    for v in vectors:
        if n < wanted and not (chosen[:n] @ v > ALIKE).any():
            chosen[n] = v
            n += 1
    rest = np.random.default_rng(size).standard_normal((wanted - n, size))
    chosen[n:] = rest / np.sqrt((rest * rest).sum(axis=1, keepdims=True))
    return chosen


def permutation_stage(pivots: np.ndarray, near: int):
    """Each class with its nearest pivots, nearest first."""

    def stage(batches):
        for b in batches:
            if not b.num_rows:
                continue
            far = -(units(b.column("v").to_pylist(), pivots.shape[1]) @ pivots.T)
            # ties by the pivot's number
            first = np.argsort(far, axis=1, kind="stable")[:, :near].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(first), pa.list_(pa.int32()))], [*b.schema.names, "near"])

    return stage


ENTRIES = "label long, list int, key binary, n long, v binary, near binary"


def entry_stage(rank: np.ndarray, lists: int):
    """Classes to their entries in the lists of their rarest pivots; `near` becomes ranks, sorted."""

    def stage(batches):
        for b in batches:
            near = np.sort(rank[b.column("near").flatten().to_numpy().reshape(b.num_rows, -1)], axis=1) if b.num_rows else np.empty((0, lists), np.int16)
            rows = pa.array(np.repeat(np.arange(b.num_rows), lists))
            sets = pa.array([r.astype(np.int16).tobytes() for r in near], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("label").take(rows), pa.array(near[:, :lists].reshape(-1), pa.int32()), *(b.column(c).take(rows) for c in ("key", "n", "v")), sets.take(rows)], ["label", "list", "key", "n", "v", "near"])

    return stage


def shared_counts(near: np.ndarray, rows: np.ndarray, order: np.ndarray, starts: dict) -> np.ndarray:
    """Pivots that each of the rows shares with each of all, through the inverted lists of those that the group holds."""
    counts = np.zeros((len(rows), len(near)), np.uint8)
    flat = near[rows].reshape(-1)
    by = np.argsort(flat, kind="stable")
    who = by // near.shape[1]
    cut = np.flatnonzero(np.diff(flat[by], prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(by))):
        a, z = starts[int(flat[by[lo]])]
        counts[np.ix_(who[lo:hi], order[a:z])] += 1
    return counts


def joined_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


LINKS = "key binary, links long, root binary"


def cell_stage(size: int, lists: int, shared: int, bound: float):
    """The members of a list, or of two of its blocks, to their links and the roots of their components there."""

    def stage(table):
        key, n = table.column("key").to_pylist(), table.column("n").to_numpy()
        here, block = table.column("list")[0].as_py(), table.column("block").to_numpy()
        two = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        near = np.stack([np.frombuffer(x, np.int16) for x in table.column("near").to_pylist()])
        x = units(table.column("v").to_pylist(), size)
        flat = near.reshape(-1)
        order = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.diff(flat[order], prepend=-1))
        starts = {int(flat[order[a]]): (a, z) for a, z in zip(edge, np.append(edge[1:], len(order)))}
        members = order // near.shape[1]
        links, left, right = np.zeros(len(key), np.int64), [], []
        for lo in range(0, len(key), ROWS):
            rows = np.arange(lo, min(lo + ROWS, len(key)))
            enough = shared_counts(near, rows, members, starts) >= shared
            enough &= rows[:, None] < np.arange(len(key))[None, :]
            if two:
                enough &= block[rows][:, None] != block[None, :]
            a, b = np.nonzero(enough)
            if not len(a):
                continue
            if len(a) > 16 * len(key):
                cosine = (x[rows] @ x.T)[a, b]
            else:
                cosine = np.einsum("ij,ij->i", x[rows[a]], x[b])
            a, b = rows[a[cosine >= bound]], b[cosine >= bound]
            # in the first list that both are in, and there alone
            for m in range(0, len(a), 1 << 16):
                p, q = a[m : m + (1 << 16)], b[m : m + (1 << 16)]
                earlier = (near[p, :lists, None] == near[q, None, :lists]).any(axis=2) & (near[p, :lists] < here)
                own = ~earlier.any(axis=1)
                left.append(p[own])
                right.append(q[own])
        if not left:
            return pa.table({"key": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        a, b = np.concatenate(left), np.concatenate(right)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        root = joined_roots(len(key), a, b)
        out = np.flatnonzero(links)
        return pa.table({"key": pa.array([key[i] for i in out], pa.binary()), "links": pa.array(links[out]), "root": pa.array([key[root[i]] for i in out], pa.binary())})

    return stage


def pivot_number(rows: int) -> int:
    m = LEAST
    while m < MOST and m * m < rows:
        m *= 2
    return m


def near_vectors(rows: DataFrame, bound: float = COSINE, near: int = NEAR, shared: int = SHARED, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, label, vector): the other vectors of its label whose cosine with it is
    at least `bound` and which the index finds, the least vec_id reachable by links, and whether that is its own."""
    spark = rows.sparkSession
    small_batches(spark)
    given = rows.select("vec_id", F.col("label").cast("long").alias("label"), "vector")
    size = given.agg(F.max(F.size("vector"))).first()[0]
    size = max(int(size or 0), 1)
    whole = given.where("vec_id is not null and label is not null and vector is not null")
    keyed = stored(whole.mapInArrow(key_stage(size), "vec_id long, label long, key binary, v binary"))
    classes = stored(keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    total = classes.count()
    wanted = pivots or pivot_number(total)
    # bounded: four vectors a pivot at most
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(4 * wanted).select("v").toArrow().column("v").to_pylist()
    points = pivots_of(units(sample, size), wanted, size)
    described = stored(classes.select("key", "label", "n", "v").mapInArrow(permutation_stage(points, near), "key binary, label long, n long, v binary, near array<int>"))

    sizes = stored(described.select("label", F.explode("near").alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("size")))
    often = {r.pivot: r.n for r in sizes.groupBy("pivot").agg(F.sum("size").alias("n")).collect()}  # a row for each pivot
    rank = np.empty(wanted, np.int16)
    rank[sorted(range(wanted), key=lambda p: (often.get(p, 0), p))] = np.arange(wanted)
    lists = near - shared + 1

    entries = described.mapInArrow(entry_stage(rank, lists), ENTRIES)
    ranks = spark.createDataFrame([(p, int(r)) for p, r in enumerate(rank)], "pivot int, list int")
    long = sizes.where(F.col("size") > block).join(F.broadcast(ranks), "pivot").select("label", "list", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = entries.join(sized(long), ["label", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "v", "near")
    found = stored(dealt.groupBy("label", "list", "i", "j").applyInArrow(cell_stage(size, lists, shared, bound), LINKS))

    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("cls", "key")
    member = classes.select("key", "n", "least").join(counted, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    result = member.join(least, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    linked = keyed.select("vec_id", "key").join(result, "key").select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    ok, x = "vec_id is not null and label is not null and vector is not null", F.col("vector")
    good = F.coalesce(F.expr(ok) & F.exists(x, lambda c: c != 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    alone = given.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def one_of_each(rows: DataFrame) -> DataFrame:
    """The rows (vec_id, label, vector and others) that are kept."""
    kept = near_vectors(rows).where("kept").select(F.col("vec_id").alias("kept_id")).where("kept_id is not null").distinct()
    return rows.join(kept, rows["vec_id"] == F.col("kept_id"), "left_semi").unionByName(rows.where("vec_id is null"))


def recall(found: DataFrame, rows: DataFrame, bound: float = COSINE) -> float:
    """The share of the links of the rows whose vec_id is divisible by 100 that were found, by comparing these with all rows."""
    given = rows.where("vec_id is not null and label is not null and vector is not null").select("vec_id", "label", F.col("vector").cast("array<double>").alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    asked = given.where("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), "label", F.col("x").alias("y"))
    near = given.join(asked, "label").where("vec_id <> asked").where(dot("x", "y") >= bound * F.sqrt(dot("x", "x") * dot("y", "y")))
    true = near.groupBy("asked").agg(F.count("*").alias("n"))
    total = found.where("vec_id % 100 = 0").join(true, F.col("vec_id") == F.col("asked")).agg(F.sum("n_links").alias("got"), F.sum("n").alias("all")).first()
    return 1.0 if not total["all"] else total["got"] / total["all"]


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    return near_vectors(rows)


ORACLE_OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS p, b.vec_id AS q FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT r.vec_id, l.q AS m FROM r JOIN l ON l.p = r.m),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT p, count(*) AS n FROM l GROUP BY p)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON p = vec_id
"""
