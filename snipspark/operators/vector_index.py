"""Nearest vectors through inverted files: vectors are kept by the k-means cell they lie in, a query reads the cells nearest
to it alone. With all cells the result is exact.

Cells are found by rounds of k-means over all rows (directions count, as similarity is a cosine): a task adds up the
vectors nearest to each centre, sums meet by cell. Only centres come to the driver, at most MOST of them. A cell's vectors and
the queries that ask for it meet in blocks of bounded size, so neither a large cell nor a much asked one is a single task's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.store import Store
from .search import PAIRS, Best, cosines, half_up, matrix, small, top_k

#: Cells by default: a power of two near the root of the rows, between these.
LEAST, MOST = 16, 4096
ROUNDS = 5
#: Vectors and queries of a block.
VECTORS, QUERIES = 32_768, 4096
#: Rows that leave a task at once.
ROWS = 16_384
#: Queries that the number of cells to read is tuned on, and the recall wanted.
TUNED, TARGET = 256, 0.9


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n cells of each row, nearest first; ties by number."""
    out, step = np.zeros((len(x), min(n, len(centres))), np.int64), max(1, PAIRS // max(len(centres), 1))
    for lo in range(0, len(x), step):
        near = x[lo : lo + step] @ centres.T
        out[lo : lo + step] = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


def sized_to(rows: np.ndarray, dims: int) -> np.ndarray:
    """Unit rows of another length become zeros."""
    return rows if rows.shape[1] == dims else np.zeros((len(rows), dims))


def centres(rows: DataFrame, cells: int, rounds: int = ROUNDS, vector: str = "vector") -> np.ndarray:
    """Unit centres of `cells` cells, fewer where there are fewer different vectors."""
    first = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(2 * cells).toArrow().column(vector)
    start = matrix(first)
    start = np.unique(start[start.any(axis=1)], axis=0)
    if not len(start):
        return np.ones((1, 1))
    held = start[np.random.default_rng(0).permutation(len(start))[:cells]]
    for _ in range(rounds):

        def sums(batches, held=held):
            total, n = np.zeros(held.shape), np.zeros(len(held), np.int64)
            for b in batches:
                x = sized_to(matrix(b.column(vector)), held.shape[1])
                cell = nearest_cells(x, held, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(held))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["cell", "total"])

        def added(table):
            total = np.sum(table.column("total").to_pylist(), axis=0)
            return pa.table({"cell": table.column("cell")[:1], "total": pa.array([total], pa.list_(pa.float64()))})

        kind = "cell int, total array<double>"
        new = rows.select(vector).mapInArrow(sums, kind).groupBy("cell").applyInArrow(added, kind).toArrow()
        # a cell without vectors keeps its centre
        held = held.copy()
        at, moved = new.column("cell").to_numpy(), matrix(new.column("total"))
        some = moved.any(axis=1) if len(at) else np.zeros(0, bool)
        held[at[some]] = moved[some]
    return held


def located(rows: DataFrame, held: np.ndarray, n: int = 1, vector: str = "vector") -> DataFrame:
    """The rows with `cell`, once for each of their n nearest cells."""

    def stage(batches):
        for b in batches:
            x = sized_to(matrix(b.column(vector)), held.shape[1])
            near = nearest_cells(x, held, n) if len(x) else np.zeros((0, n), np.int64)
            # rows that go to many cells leave in pieces
            step = max(1, ROWS // max(near.shape[1], 1))
            for lo in range(0, b.num_rows, step):
                part, cells = b.slice(lo, step), near[lo : lo + step]
                take = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in b.schema.names), pa.array(cells.reshape(-1), pa.int32())], [*b.schema.names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(stage, f"{kinds}, cell int")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(cell, number of blocks of at most about `size` rows); a row for each cell."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))


def in_blocks(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int, vector: str = "vector", digits: int = 6, each: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """(query, key, cosine, cell, rank): for queries (query, vector, cell) the k nearest vectors (key, vector, cell) of their cells; cells may be of any type. Each
    block of a cell's vectors meets each block of its queries in a task, which multiplies and keeps the k best of each query."""
    shape = blocks(vectors, each[0]).withColumnRenamed("n", "rows").join(blocks(queries, each[1]), "cell")
    shape = small(stored(shape))  # a row for each cell
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    ours = vectors.join(shape, "cell").select("cell", dealt(key, "rows").alias("i"), every("n").alias("j"), key, vector)
    theirs = queries.join(shape, "cell").select("cell", every("rows").alias("i"), dealt(query, "n").alias("j"), query, F.col(vector).alias("wanted"))

    def stage(left, right):
        names = right.column(query).combine_chunks()
        best = Best(len(names), k)
        if len(names) and left.num_rows:
            wanted = right.column("wanted").combine_chunks()
            step = max(64, PAIRS // len(names))
            for lo in range(0, left.num_rows, step):
                part = left.slice(lo, step).combine_chunks()
                best.add(half_up(cosines(part.column(vector).combine_chunks(), wanted), digits), part.column(key).combine_chunks())
        q, s, keys = best.prune()
        cell = left.column("cell")[0].as_py() if left.num_rows else None
        return pa.table({query: names.take(pa.array(q)), key: keys if keys is not None else left.column(key).combine_chunks()[:0], "cosine": pa.array(s), "cell": pa.array([cell] * len(q), left.column("cell").type)})

    cells = vectors.schema["cell"].dataType.simpleString()
    kinds = vectors.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    found = ours.groupBy("cell", "i", "j").cogroup(theirs.groupBy("cell", "i", "j")).applyInArrow(stage, f"{query} {kinds[1]}, {key} {kinds[0]}, cosine double, cell {cells}")
    return top_k(found, query, "cosine", key, k)


class VectorStore(Store):
    """Vectors (id, vector and, if given, meta: map<string,string>) by cell. The cells are those of the first `build`; later
    rows go to the nearest. Each change is one commit that writes the cells it touches."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", vector_type: str = "array<double>"):
        schemas = {"vectors": f"id {id_type}, vector {vector_type}, meta map<string,string>, cell int", "centres": "cell int, centre array<double>"}
        super().__init__(spark, root, schemas, {"vectors": "id"})

    def place(self, name: str, buckets: int) -> Column:
        return F.col("cell") if name == "vectors" else F.lit(0)

    def _given(self, rows: DataFrame) -> DataFrame:
        meta = F.col("meta") if "meta" in rows.columns else F.lit(None).cast("map<string,string>").alias("meta")
        return rows.select("id", "vector", meta)

    def centres(self) -> np.ndarray:
        """At most MOST of them."""
        held = self.table("centres").orderBy("cell").toArrow().column("centre").to_pylist()
        return np.array(held) if held else np.ones((1, 1))

    def build(self, rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> None:
        """Everything anew. Of rows that share an id all stay."""
        rows = self._given(rows)
        if cells is None:
            cells, n = LEAST, rows.count()
            while cells < MOST and cells * cells < n:
                cells *= 2
        held = centres(rows, cells, rounds)
        table = self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(held)], self.schemas["centres"])
        self.commit(whole={"vectors": located(rows, held), "centres": table})

    def _gone(self, ids: DataFrame) -> DataFrame:
        """Where the ids are now."""
        return self.table("vectors").select("id", "cell").join(ids.select("id").distinct(), "id", "left_semi")

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those with their ids, whatever cell these are in."""
        new = stored(located(self._given(rows), self.centres()))
        self.commit(replaced={"vectors": (new, self._gone(new).unionByName(new.select("id", "cell")))})

    def delete(self, ids: DataFrame) -> None:
        gone = stored(self._gone(ids))
        self.commit(replaced={"vectors": (self.spark.createDataFrame([], self.schemas["vectors"]), gone)})

    def count(self) -> int:
        return self.table("vectors").count()

    def search(self, queries: DataFrame, query: str, k: int, probes: int | None = None, where: Column | None = None, digits: int = 6) -> DataFrame:
        """(query, id, cosine, cell, rank): the k nearest of each query (columns query, vector) in its `probes` nearest cells; all
        cells without probes. `where` is a condition on id and meta. Files of other cells aren't read."""
        held = self.centres()
        asked = stored(located(queries.select(query, "vector"), held, min(probes or len(held), len(held))))
        cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most one for each cell
        vectors = self.table("vectors", cells)
        return in_blocks(vectors if where is None else vectors.where(where), asked, "id", query, k, digits=digits)

    def tuned(self, queries: DataFrame, query: str, k: int, target: float = TARGET) -> int:
        """The fewest cells that hold `target` of the true k nearest of a bounded sample of queries."""
        held = self.centres()
        some = queries.select(query, "vector").orderBy(F.xxhash64(query)).limit(TUNED)
        hits = self.search(some, query, k).select(query, "cell")
        vectors = some.toArrow()
        near = nearest_cells(sized_to(matrix(vectors.column("vector")), held.shape[1]), held, len(held))
        place = {name: {int(c): i for i, c in enumerate(row)} for name, row in zip(vectors.column(query).to_pylist(), near)}
        needed = sorted(place[r[0]][r[1]] + 1 for r in hits.collect())  # k rows for each query of the sample
        return needed[min(int(np.ceil(target * len(needed))), len(needed)) - 1] if needed else 1
