"""Shared kernels: hashing of words in NumPy, sorted key runs that travel as byte planes, scratch folders.

Python stages here never ship one row per word through Spark. A task turns its texts into NumPy arrays, sorts them
and ships one row per key range with the arrays as binary columns; the other side joins whole arrays again. The
arrays are stored byte plane by byte plane, so that the zero bytes of small numbers cost nothing after compression.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the window hashes and of the final mixing.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK64 = (1 << 64) - 1
#: Masks of the first bytes of eight, and the bytes of a word from which on it is hashed by itself.
HEADS, LONG = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64), 256
#: Spark's bound on the bytes of an Arrow batch, and the one that text stages set.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
#: Bytes of text that a stage takes apart at once where each word or character costs many times its size.
PIECE = 1 << 18


class WordHashes(dict):
    """Memo of 64-bit hashes of words; emptied at a fixed number of entries, so it stays small on any vocabulary."""

    def __init__(self, seed: int = 0, limit: int = 500_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


def hashed_words(texts: list[list[bytes]], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts end to end, and the offset at which each text begins (one more at the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), U64, int(offsets[-1])), offsets


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes that aren't white, A-Z in lower case unless told otherwise) of several texts end to end, and the offset
    at which each text's begin (one more at the end). Whole arrays of words are hashed eight bytes a step, so it costs the
    same on any vocabulary; words of more than LONG bytes are hashed one by one."""
    sizes = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    raw = b"\n".join([b"", *(t or b"" for t in texts), bytes(8)])
    raw = raw.lower() if lower else raw
    chars = np.frombuffer(raw, np.uint8, len(raw) - 8)
    gap = (chars == 32) | (chars - np.uint8(9) < 5)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    lo, n = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mixed(n.astype(U64) * U64(BASE) ^ (eight[lo] & HEADS[np.minimum(n, 8)]))
    rest, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(rest):
        h[rest] = mixed(h[rest] * U64(BASE) ^ (eight[lo[rest] + at] & HEADS[np.minimum(n[rest] - at, 8)]))
        at += 8
        rest = rest[n[rest] > at]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[lo[i] : lo[i] + n[i]])
    return h, np.searchsorted(lo, np.append(0, np.cumsum(sizes)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(MIX[0])
    x ^= x >> U64(27)
    x *= U64(MIX[1])
    x ^= x >> U64(31)
    return x


def window_hashes(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of `width` consecutive values (empty if there are fewer), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    done, total, power, size, step = None, 0, base, 1, h
    rest = width
    while rest:
        if rest & 1:
            if done is None:
                done, total = step, size
            else:
                m = len(h) - total - size + 1
                done = done[:m] * U64(pow(base, size, 1 << 64)) + step[total : total + m]
                total += size
        rest >>= 1
        if rest:
            m = len(step) - size
            step = step[:m] * U64(power) + step[size:]
            power = power * power & MASK64
            size *= 2
    return mixed(done[:n])


def text_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(texts: list, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a text is never cut."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def planes(a: np.ndarray) -> bytes:
    """The array byte plane by byte plane, little end first; compresses to about its significant bytes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def joined(blobs, dtype) -> np.ndarray:
    parts = [unplanes(b, dtype) for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def taken(found: list[np.ndarray]) -> np.ndarray:
    """The arrays end to end; the list is emptied, so that its arrays are free."""
    whole = np.concatenate(found)
    found.clear()
    return whole


def flat(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of lo[i] .. lo[i] + n[i] - 1, end to end."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total, dtype=np.int64) + np.repeat(lo - (ends - n), n)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which looks after this itself
        pass


def frugal(stage):
    """A stage over batches that gives its memory back when it ends."""

    def run(batches):
        yield from stage(batches)
        give_back()

    return run


def frugal_group(stage):
    """The same for a stage over the table of a group."""

    def run(table):
        out = stage(table)
        give_back()
        return out

    return run


def frugal_groups(stage):
    """The same for a stage over the tables of two groups."""

    def run(left, right):
        out = stage(left, right)
        give_back()
        return out

    return run


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches between the JVM and Python workers by bytes, so that what both hold of a task's input doesn't
    grow with its rows or their lengths (a single longer row is a batch of its own). A bound that the session has stays;
    ours stays set, as it counts when a plan runs, not when it is made. Results don't depend on it."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the input's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def ranges_for(df: DataFrame, each: int = 8 << 20) -> int:
    """How many key ranges keep what one reducing task holds in memory to some tens of MB: a power of two, by input size."""
    n = 64
    size = min(input_bytes(df), 1 << 50)
    while n * each < size and n < 1 << 17:
        n *= 2
    return n


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder that the cluster names; without a cluster, where none is named, one under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_uid(df: DataFrame) -> DataFrame:
    """A number for each row; rows of one task are numbered consecutively."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def ascii_lower(text):
    """A-Z lower-cased and nothing else; the usual case of ASCII text takes the built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
