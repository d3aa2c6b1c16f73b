"""K-d tree sharding by bytes; DataFrame functions only.

The metadata of all documents (a few numbers a row) is stored once. A node that stands for several shards is split along
its widest dimension, relative to that dimension's width over all rows, at the weighted median of the bytes: all nodes of
a level at once, by histograms of BINS bins that are refined around the wanted share until a bin holds one row. The
driver sees only the histograms of at most `shards` nodes; the tree is then one expression over the metadata.

Dimensions are functions of the text, and rows of one value are ordered by the text's digest and then by a hash of id and text.
So equal texts lie side by side. A group of them goes whole to the side that comes nearer to the share, and so shares a shard; only a
group of more bytes than an even shard is cut, by the hash. Nothing depends on how a scan is split.

Cases: a null text has no bytes (size 8, crc 0) and is a document like the others. Repeated rows each get a slot; rows alike in doc_id and
text share a shard, however many. Null doc_ids are kept and come first within their part of a shard. Fewer rows than shards leave shards empty. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
BINS = 512
#: Bits of a key that tell rows of a group apart.
TIE = 16
#: Rows of a shard that are numbered together.
STRIP = 20_000
TOP = 1 << 30


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hashes of the text (digest) and of the row (uid), and each dimension."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.xxhash64(text).alias("digest"), F.xxhash64("doc_id", text).alias("uid"))
    return stored(base)


def keyed(meta: DataFrame, dims: list[str], leaf: float) -> DataFrame:
    """With each dimension as one ordered number, 30 bits of its value, 16 of the text's digest, 16 of the row's hash, and whether
    the row's group has more bytes than a leaf."""
    # fewer groups than leaves
    large = [r.digest for r in meta.groupBy("digest").agg(F.sum("size").alias("b")).where(F.col("b") > leaf).collect()]
    meta = meta.withColumn("large", F.col("digest").isin(large) if large else F.lit(False))
    bounds = meta.agg(*(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))).first()
    tie = F.shiftleft(F.pmod("digest", F.lit(1 << 16)), TIE).bitwiseOR(F.pmod("uid", F.lit(1 << TIE)))
    for d in dims:
        lo, hi = bounds[f"lo_{d}"] or 0, bounds[f"hi_{d}"] or 0
        scaled = F.floor((F.col(d) - lo).cast("double") / max(hi - lo, 1) * (TOP - 1)).cast("long")
        meta = meta.withColumn(f"k_{d}", F.shiftleft(scaled, 32).bitwiseOR(tie))
    return stored(meta.drop("chars", "digest"))


def placed(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """With the node of each row (the first shard of those it stands for): the tree as nested conditions, of which a row meets one path."""
    tree: dict = {"node": 0}
    leaf = {0: tree}
    for at, half, dim, cut in splits:
        here = leaf[at]
        left, right = {"node": at}, {"node": at + half}
        here.clear()
        here.update(dim=dim, cut=cut, left=left, right=right)
        leaf |= {at: left, at + half: right}

    def column(t):
        return F.lit(t["node"]) if "node" in t else F.when(F.col(f"k_{t['dim']}") > t["cut"], column(t["right"])).otherwise(column(t["left"]))

    return rows.withColumn("node", column(tree))


def cuts(rows: DataFrame, wanted: dict) -> dict:
    """For each node (dim, share, lo, hi): the largest key of the left side, whose bytes come nearest to its share without parting
    a group, unless it is a large one. First whole groups are weighed, then the rows of one that is large."""
    totals = {r["node"]: r["b"] for r in rows.groupBy("node").agg(F.sum("size").alias("b")).collect()}
    state = {n: {"dim": d, "lo": lo >> TIE, "hi": (hi >> TIE) + 1, "left": 0, "goal": share * totals[n], "shift": TIE} for n, (d, share, lo, hi) in wanted.items()}
    done = {}
    while state:
        key, lo, width = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
        for n, s in state.items():
            here = F.col("node") == n
            own = F.shiftright(f"k_{s['dim']}", s["shift"])
            key, lo, width = F.when(here, own).otherwise(key), F.when(here, F.lit(s["lo"])).otherwise(lo), F.when(here, F.lit(max(1, -(-(s["hi"] - s["lo"]) // BINS)))).otherwise(width)
        bins = rows.where(F.col("node").isin(list(state))).select("node", "size", "large", key.alias("key"), lo.alias("lo"), width.alias("width")).withColumn("bin", F.expr("(key - lo) div width")).where(f"key >= lo and bin < {BINS}")
        found: dict = {}
        for r in bins.groupBy("node", "bin").agg(F.sum("size").alias("b"), F.min("key").alias("least"), F.max("key").alias("most"), F.bool_or("large").alias("large")).collect():
            found.setdefault(r["node"], []).append((r["bin"], r["b"], r["least"], r["most"], r["large"]))
        for n in list(state):
            s = state[n]
            left = s["left"]
            for b, size, lo, most, large in sorted(found.get(n, [])):
                if left + size >= s["goal"] or b == max(x[0] for x in found[n]):
                    hi = most + 1
                    if lo < most:
                        state[n] = s | {"lo": lo, "hi": hi, "left": left}
                    elif s["shift"] and large:
                        state[n] = s | {"lo": lo << TIE, "hi": hi << TIE, "left": left, "shift": 0}
                    else:
                        # on the side that is nearer to the share
                        done[n] = ((hi if left + size - s["goal"] <= s["goal"] - left else lo) << s["shift"]) - 1
                        del state[n]
                    break
                left += size
            else:
                done[n] = (s["hi"] << s["shift"]) - 1
                del state[n]
    return done


def kd_shards(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("size", "text_crc32", "chars")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row."""
    base = metadata(docs)
    meta = keyed(base, list(dims), (base.agg(F.sum("size")).first()[0] or 0) / shards)
    splits, nodes = [], {0: shards}
    while any(k > 1 for k in nodes.values()):
        rows = placed(meta, splits)
        span = {r["node"]: r for r in rows.groupBy("node").agg(*(f(f"k_{d}").alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        wanted, after = {}, {}
        for n, k in nodes.items():
            if k == 1 or n not in span:
                after[n] = 1  # of a node without rows the other shards stay empty
                continue
            widest = max(dims, key=lambda d: span[n][f"hi_{d}"] - span[n][f"lo_{d}"])
            wanted[n] = (widest, (k // 2) / k, span[n][f"lo_{widest}"], span[n][f"hi_{widest}"])
            after |= {n: k // 2, n + k // 2: k - k // 2}
        for n, cut in cuts(rows, wanted).items():
            splits.append((n, nodes[n] // 2, wanted[n][0], cut))
        nodes = after
    rows = placed(meta, splits).select("doc_id", "size", "text_crc32", "uid", F.col("node").alias("shard"))
    strips = max(1, -(-meta.count() // (shards * STRIP)))
    rows = rows.withColumn("strip", F.pmod("uid", F.lit(strips)))
    counts = rows.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "strip").orderBy(F.col("doc_id").asc_nulls_first(), "uid")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "strip"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kd_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
