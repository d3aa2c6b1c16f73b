"""Hard negatives by a Voronoi-partitioned join of anchors with their nearest vectors by integer inner product.

With M the largest norm, a vector s becomes (s, sqrt(M^2 - |s|^2)) and an anchor a becomes (a, 0): the squared distance of
the two is M^2 + |a|^2 - 2 a.s, so the nearest vectors are those of the largest products. Pivots, a bounded sample of the
anchors, cut space into cells. Neighbouring cells are packed into groups of bounded numbers of anchors, and a cell of more anchors is
dealt over several groups. What a group needs at least follows from bounds of its cells: in the first round the product that a label's
vectors nearest to the pivots guarantee for the last positive, in the second the products of the positives found. A vector is sent only to groups with a
cell that it might serve by the triangle inequality; the vectors of a group are dealt over tasks by their ids, and each
task multiplies its vectors with its anchors and keeps the best of each.

In many dimensions and without structure the inequality excludes little, and each vector goes to nearly each group: then
what is moved is vectors times groups plus anchors times tasks, with large blocks on both sides; products stay in tasks.

Cases: rows whose vec_id, label or vector is null, and empty vectors and those with null or non-finite components, take no part. Shorter vectors
count as padded by zeros. Components beyond 2^26 after scaling count as 2^26. Rows that share a vec_id are never
each other's positives or negatives; of equal ids and scores one is returned; of anchors that share a vec_id the least by
label and vector counts. Anchors without positives or without rows in the band give no rows. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .decontaminate import sized
from .near_vectors import as_matrix

POSITIVES, NEGATIVES = 5, 5
#: The band of negatives' scores, in hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE, LARGEST = 256, 1 << 26
#: Anchors of a group, vectors of a task, groups at least, pivots.
ANCHORS, VECTORS, GROUPS, PIVOTS = 65_536, 131_072, 4, (32, 256)
#: Products made at once.
PRODUCTS = 1 << 24
NEVER = np.iinfo(np.int64).min


def packed(x: np.ndarray) -> list[bytes]:
    """Whole numbers as bytes, two a component where they fit."""
    small = (np.abs(x) < 1 << 15).all(axis=1)
    a, b = x.astype(np.int16), x.astype(np.int32)
    return [(a if s else b)[i].tobytes() for i, s in enumerate(small)]


def unpacked(blobs: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(blobs), size), np.int64)
    if blobs and all(len(b) == 2 * size for b in blobs):
        out[:] = np.frombuffer(b"".join(blobs), np.int16).reshape(-1, size)
        return out
    for row, b in zip(out, blobs):
        row[:] = np.frombuffer(b, np.int16 if len(b) == 2 * size else np.int32)
    return out


def whole_numbers(column, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(scale * x)."""
    ok, x = as_matrix(column, size)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.clip(np.floor(scale * x), -LARGEST, LARGEST)
    return ok, np.where(ok[:, None], x, 0).astype(np.int64)


def kind_for(a: np.ndarray, b: np.ndarray):
    """The fastest type whose products are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def shape_stage(size: int, scale: float):
    """(largest squared norm, rows) of the rows that take part."""

    def stage(batches):
        for b in batches:
            ok, x = whole_numbers(b.column("vector"), size, scale)
            yield pa.RecordBatch.from_pydict({"most": pa.array([float((x * x).sum(axis=1).max(initial=0))]), "n": pa.array([int(ok.sum())], pa.int64())})

    return stage


class Space:
    """The pivots and the geometry; all distances are of the augmented vectors."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots.astype(np.float64), most
        self.norms = (self.pivots**2).sum(axis=1)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        own = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] if anchors else self.most
        return np.sqrt(np.maximum(own + self.norms - 2 * (x.astype(np.float64) @ self.pivots.T), 0))

    def between(self) -> np.ndarray:
        return self.distances(self.pivots, True)

    def groups(self, cells: dict[int, int], anchors: int, least: int) -> dict[int, list[int]]:
        """The groups of each cell: near cells share one; a cell of more anchors than a group may have gets several."""
        far, out, group, held = self.between(), {}, 0, 0
        limit = max(1, min(anchors, -(-sum(cells.values()) // least)))
        rest, at = set(cells), min(cells)
        while rest:
            rest.discard(at)
            n = cells[at]
            if held and held + n > limit:
                group, held = group + 1, 0
            parts = max(1, -(-n // limit))
            out[at] = list(range(group, group + parts))
            group, held = (group + parts, 0) if parts > 1 else (group, held + n)
            if rest:
                at = min(rest, key=lambda c: (far[at, c], c))
        return out


def placed_stage(space: Space, size: int, scale: float):
    """(vec_id, label, vector) to whole numbers with the nearest pivot and the distance to it."""

    def stage(batches):
        for b in batches:
            ok, x = whole_numbers(b.column("vector"), size, scale)
            rows = np.flatnonzero(ok)
            x = x[rows]
            far = space.distances(x, False)
            cell = far.argmin(axis=1)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("label").take(take), pa.array(packed(x), pa.binary()), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell])], ["vec_id", "label", "v", "cell", "far"])

    return stage


def anchor_stage(space: Space, size: int):
    """Anchors with their cell, the distance to its pivot and their squared norm."""

    def stage(batches):
        for b in batches:
            x = unpacked(b.column("v").to_pylist(), size)
            far = space.distances(x, True)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell]), pa.array((x * x).sum(axis=1).astype(np.float64))], ["vec_id", "label", "v", "cell", "far", "norm"])

    return stage


def served_stage(space: Space, size: int, cells: list[tuple], groups: dict[int, list[int]]):
    """Vectors to the groups they might serve. A cell (number, radius, largest squared norm of its anchors, least product that counts) is
    served if its nearest anchor to the vector could reach that product."""
    number = np.array([c[0] for c in cells], np.int64)
    radius, norm, least = (np.array([c[i] for c in cells], np.float64) for i in (1, 2, 3))

    def stage(batches):
        for b in batches:
            x = unpacked(b.column("v").to_pylist(), size)
            nearest = np.maximum(space.distances(x, False)[:, number] - radius, 0)
            reach = (space.most + norm - nearest**2) / 2
            row, cell = np.nonzero(reach >= least - 1e-6 * (space.most + 1))
            pairs = sorted({(r, g) for r, c in zip(row.tolist(), cell.tolist()) for g in groups[int(number[c])]})
            take = pa.array([p[0] for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int32()), *(b.column(c).take(take) for c in ("label", "vec_id", "v"))], ["grp", "label", "vec_id", "v"])

    return stage


class Best:
    """The k best (score, then least id) of each query among what was added; equal ids and scores are one."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.held, self.count = k, [], 0
        self.floor = np.full(queries, NEVER) if floor is None else floor.copy()

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.held.append((q, score, key))
        self.count += len(q)
        if self.count > max(4 * self.k * len(self.floor), 1 << 20):
            self.best()

    def best(self) -> tuple:
        q, s, key = (np.concatenate(x) if self.held else np.empty(0, np.int64) for x in (zip(*self.held) if self.held else ((), (), ())))
        order = np.lexsort((key, -s, q))
        q, s, key = q[order], s[order], key[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (key[1:] != key[:-1])
        q, s, key = q[new], s[new], key[new]
        at = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, s, key = (x[at < self.k] for x in (q, s, key))
        full = np.flatnonzero(np.bincount(q, minlength=len(self.floor)) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], s[np.searchsorted(q, full, "right") - 1])
        self.held, self.count = [(q, s, key)], len(q)
        return q, s, key


def products(anchors: pa.Table, vectors: pa.Table, size: int):
    """Blocks of (first vector, products of all anchors with the block's vectors)."""
    a, v = (unpacked(t.column("v").to_pylist(), size) for t in (anchors, vectors))
    kind = kind_for(a, v)
    a, v = a.astype(kind), v.astype(kind)
    step = max(16, PRODUCTS // max(len(a), 1))
    for lo in range(0, len(v), step):
        yield lo, (a @ v[lo : lo + step].T).astype(np.int64)


def positive_stage(size: int, k: int):
    """The anchors and some vectors of a label to each anchor's best others among them."""

    def stage(anchors, vectors):
        ids, keys = anchors.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
        best = Best(len(ids), k)
        if len(ids) and len(keys):
            for lo, s in products(anchors, vectors, size):
                here = keys[lo : lo + s.shape[1]]
                q, c = np.nonzero((s >= best.floor[:, None]) & (ids[:, None] != here[None, :]))
                best.add(q, s[q, c], here[c])
        q, s, key = best.best()
        return pa.table({"anchor_id": pa.array(ids[q], pa.int64()), "positive_id": pa.array(key, pa.int64()), "positive_score": pa.array(s, pa.int64())})

    return stage


def negative_stage(size: int, k: int, low: int, high: int):
    """Anchors with the scores of their positives, and some vectors, to the best of other labels in each score's band."""

    def stage(anchors, vectors):
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        keys, theirs = vectors.column("vec_id").to_numpy(), vectors.column("label").to_numpy()
        wanted = [list(x) for x in anchors.column("scores").to_pylist()]
        width = max(map(len, wanted), default=0)
        score = np.array([w + [-1] * (width - len(w)) for w in wanted], np.int64).reshape(len(ids), width)
        floor = np.where(score < 0, np.iinfo(np.int64).max, -(-low * score // 100))
        top = np.where(score < 0, NEVER, high * score // 100)
        best = Best(score.size, k, floor.reshape(-1))
        if score.size and len(keys):
            for lo, s in products(anchors, vectors, size):
                here, label = keys[lo : lo + s.shape[1]], theirs[lo : lo + s.shape[1]]
                least, most = best.floor.reshape(score.shape).min(axis=1), top.max(axis=1)
                r, c = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (labels[:, None] != label[None, :]))
                value = s[r, c]
                for j in range(width):
                    own = (value >= best.floor.reshape(score.shape)[r, j]) & (value <= top[r, j])
                    best.add(r[own] * width + j, value[own], here[c[own]])
        q, s, key = best.best()
        return pa.table({"anchor_id": pa.array(ids[q // width] if width else [], pa.int64()), "positive_score": pa.array(score.reshape(-1)[q], pa.int64()), "negative_id": pa.array(key, pa.int64()), "negative_score": pa.array(s, pa.int64())})

    return stage


def top(rows: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor="vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, anchors: int = ANCHORS, vectors: int = VECTORS, groups: int = GROUPS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of (vec_id, label, vector) that is an anchor, and
    each of its first `positives` other rows of its label by the product of floor(scale * x), the first `negatives` rows of other
    labels whose score is in the band of `low` to `high` hundredths of the positive's. Ties by vec_id."""
    spark = rows.sparkSession
    small_batches(spark)
    given = rows.select("vec_id", F.col("label").cast("long").alias("label"), "vector").where("vec_id is not null and label is not null and vector is not null")
    size = max(int(given.agg(F.max(F.size("vector"))).first()[0] or 0), 1)
    shape = given.select("vector").mapInArrow(shape_stage(size, scale), "most double, n long").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
    most, n = shape.most or 0.0, shape.n or 0
    # bounded: the pivots are drawn from so many anchors
    sample = given.where(anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS[1]).select("vector").toArrow().column("vector")
    ok, x = whole_numbers(sample, size, scale)
    asked = given.where(anchor).count()
    pivots = np.unique(x[ok], axis=0)
    wanted = min(max(PIVOTS[0], 4 * -(-asked // anchors)), PIVOTS[1])
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:wanted]] if len(pivots) else np.zeros((1, size), np.int64)
    space = Space(pivots, most)

    placed = stored(given.mapInArrow(placed_stage(space, size, scale), "vec_id long, label long, v binary, cell int, far double"))
    one = placed.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    chosen = stored(one.mapInArrow(anchor_stage(space, size), "vec_id long, label long, v binary, cell int, far double, norm double"))
    counts = {r.cell: r.n for r in chosen.groupBy("cell").agg(F.count("*").alias("n")).collect()} or {0: 0}
    in_groups = space.groups(counts, anchors, groups)
    of_cell = F.create_map(*(F.lit(v) for c, g in in_groups.items() for v in (c, g[0])))
    several = F.create_map(*(F.lit(v) for c, g in in_groups.items() for v in (c, len(g))))
    located = chosen.withColumn("grp", (of_cell[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), several[F.col("cell")])).cast("int"))

    # first round: what the label's vectors nearest to the pivots guarantee for the last positive of an anchor of a cell
    # by ids, not rows: of rows that share one only one can be a positive
    within = Window.partitionBy("label", "cell").orderBy("far", "vec_id")
    near = placed.select("label", "cell", "far", "vec_id").withColumn("rank", F.dense_rank().over(within)).where(F.col("rank") <= positives + 1).drop("rank").distinct()
    rim = chosen.groupBy("label", "cell").agg(F.max("far").alias("radius"), F.min("norm").alias("low"), F.max("norm").alias("high"))
    gaps = space.between()
    gap = spark.createDataFrame([(i, j, float(gaps[i, j])) for i in counts for j in range(len(pivots))], "own int, cell int, gap double")
    reach = rim.select("label", F.col("cell").alias("own"), "radius", "low", "high").join(near, "label").join(F.broadcast(gap), ["own", "cell"])
    upper = reach.groupBy("label", "own", "vec_id").agg(F.min(F.col("radius") + F.col("gap") + F.col("far")).alias("ub"), F.first("low").alias("low"))
    last = upper.withColumn("rank", F.row_number().over(Window.partitionBy("label", "own").orderBy("ub"))).where(F.col("rank") == positives + 1)
    least = last.select("label", F.col("own").alias("cell"), ((F.lit(most) + F.col("low") - F.col("ub") * F.col("ub")) / 2).alias("least"))
    bounds = rim.join(least, ["label", "cell"], "left").groupBy("cell").agg(F.max("radius").alias("radius"), F.max("high").alias("high"), F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    first = [tuple(r) for r in bounds.collect()]  # a row for each pivot

    served = placed.select("vec_id", "label", "v").mapInArrow(served_stage(space, size, first, in_groups), "grp int, label long, vec_id long, v binary")
    sizes = placed.groupBy("label").agg(F.ceil(F.count("*") / vectors).cast("int").alias("parts"))
    sizes = sized(stored(sizes))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    theirs = served.join(sizes, "label").select("label", "grp", part, "vec_id", "v").groupBy("label", "grp", "part")
    ours = located.join(sizes, "label").select("label", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v").groupBy("label", "grp", "part")
    found = ours.cogroup(theirs).applyInArrow(positive_stage(size, positives), "anchor_id long, positive_id long, positive_score long")
    pairs = stored(top(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))

    # second round: the positives' scores are known
    scores = pairs.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_distinct(F.collect_list("positive_score")).alias("scores"))
    asking = stored(located.join(scores, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    second = asking.groupBy("cell").agg(F.max("far").alias("radius"), F.max("norm").alias("high"), (F.min(F.array_min("scores")) * low / 100).alias("least"))
    second = [tuple(r) for r in second.collect()]
    if not second:
        second = [(0, 0.0, 0.0, float("inf"))]
        in_groups = {0: [0], **in_groups}
    parts = max(1, -(-n // vectors))
    served = placed.select("vec_id", "label", "v").mapInArrow(served_stage(space, size, second, in_groups), "grp int, label long, vec_id long, v binary")
    theirs = served.select("grp", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "label", "vec_id", "v").groupBy("grp", "part")
    ours = asking.select("grp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "label", "vec_id", "v", "scores").groupBy("grp", "part")
    found = ours.cogroup(theirs).applyInArrow(negative_stage(size, negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    best = top(found, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return pairs.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


ORACLE_OP11 = """
WITH ok AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(256 * c) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) <= 5
"""
