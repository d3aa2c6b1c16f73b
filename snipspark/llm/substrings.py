"""Exact removal of repeated word windows, found by difference-cover anchors.

Positions of a document count modulo 13; {0, 1, 3, 9} is a difference cover: for any two positions i and j there is a
k < 13 with both i + k and j + k in it. Two equal windows of 20 words therefore share an aligned anchor of 8 words that
starts at a cover position of either. Four of thirteen positions are hashed and compared (step 1); windows around
anchors that occur again are the only ones that can repeat, and are extended to the full 20 words and compared by the
first occurrence of their sequence (step 2); words under a window that isn't a first occurrence go (step 3).

No pair of occurrences is ever formed, and a task sends one entry for each distinct key of its rows, so a passage in a
third of all documents costs each reducer one entry for each task. Anchor keys are cut to about 47 bits and more:
a false match only adds a window to compare. Window keys have 96 bits.

Cases: null and empty texts have no words and are kept as they are (n_words 0, empty kept text). Rows that share a
doc_id count as one document in the order of occurrences; of exactly equal rows none removes the other's words. Rows
with null doc_id come last in the order, as one document (doc_id 2^63 - 1 counts among them). Other columns are carried along untouched. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, frugal, frugal_group, frugal_groups, joined, pieces, planes, ranges_for, small_batches, taken, text_bytes, window_hashes, word_hashes

WIDTH = 20
#: A perfect difference cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
OTHER_BASE = 0xD6E8FEB86659FD93
#: Entries that a task gathers before it sends them.
FLUSH = 3_000_000
#: Entries of the rows that leave a task at once: a MB or two, as the JVM holds them outside its heap.
SENT = 100_000
#: Entries of a block that only passes through.
BLOCK = 50_000

ANCHORS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("passing", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("key", "ref", "pos"))])
FLAGS = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("ref", "pos"))])
WINDOWS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("passing", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("key", "more", "doc", "ref", "pos"))])
LATER = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("doc", "ref", "pos"))])
LAST = np.iinfo(np.int64).max


def rows(schema: T.StructType, found: list[tuple]) -> pa.Table:
    kinds = {T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.LongType: pa.int64()}
    columns = list(zip(*found)) or [()] * len(schema)
    return pa.table({f.name: pa.array(c, kinds[type(f.dataType)]) for f, c in zip(schema, columns)})


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def by_part(part: np.ndarray) -> list[tuple[int, slice]]:
    starts, n = runs(part)
    return [(int(part[s]), slice(s, s + k)) for s, k in zip(starts, n)]


def anchor_stage(parts: int, width: int):
    """Documents to the anchors at cover positions, by range of their keys."""
    bits = parts.bit_length() - 1
    size = width - PERIOD + 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def flush(keys, refs, places):
        key, ref, pos = taken(keys), taken(refs), taken(places)
        order = np.argsort(key, kind="stable")
        key, ref, pos = key[order], ref[order], pos[order]
        del order
        starts, n = runs(key)
        again = np.flatnonzero(np.repeat(n > 1, n))
        for i in range(0, len(again), BLOCK):
            here = again[i : i + BLOCK]
            yield from rows(ANCHORS, [(int(key[here[0]] % U64(parts)), True, b"", planes(ref[here]), planes(pos[here]))]).to_batches()
        ref, pos = ref[starts], pos[starts] | ((n > 1).astype(np.uint32) << np.uint32(31))
        key = key[starts]
        del starts, n, again
        out, count = [], 0
        for p, s in by_part((key >> U64(64 - bits)).astype(np.int32)):
            low = key[s] >> U64(64 - bits - 40) & U64((1 << 40) - 1)
            out.append((p, False, planes(low), planes(ref[s]), planes(pos[s])))
            count += len(low)
            if count >= SENT:
                yield from rows(ANCHORS, out).to_batches()
                out, count = [], 0
        if out:
            yield from rows(ANCHORS, out).to_batches()

    def stage(batches):
        keys, refs, places, count = [], [], [], 0
        for b in batches:
            texts, uids = text_bytes(b.column("text")), b.column("uid").to_numpy()
            for lo, hi in pieces(texts):
                h, at = word_hashes(texts[lo:hi], lower=False)
                n = np.diff(at)
                w = window_hashes(h, size)
                pos = np.arange(len(h)) - np.repeat(at[:-1], n)
                fits = covered[pos % PERIOD] & (pos + size <= np.repeat(np.where(n >= width, n, 0), n))
                here = np.flatnonzero(fits)
                keys.append(w[here])
                refs.append((np.repeat(uids[lo:hi], n)[here] & 0xFFFFFFFF).astype(np.uint32))
                places.append(pos[here].astype(np.uint32))
                count += len(here)
                if count >= FLUSH:
                    yield from flush(keys, refs, places)
                    count = 0
        if count:
            yield from flush(keys, refs, places)

    return stage


def repeated_stage(buckets: int):
    """The anchors of one key range to those that occur again, by bucket of their documents."""

    def stage(table):
        passing = table.column("passing").to_numpy(zero_copy_only=False)
        got = {c: table.column(c).to_pylist() for c in ("key", "ref", "pos")}
        pick = lambda c, kind, want: joined([x for x, p in zip(got[c], passing) if p == want], kind)
        key = joined([x for x, p in zip(got["key"], passing) if not p], np.uint64)
        ref, pos = pick("ref", np.uint32, False), pick("pos", np.uint32, False)
        order = np.argsort(key, kind="stable")
        ref, pos = ref[order], pos[order]
        _, n = runs(key[order])
        again = np.repeat(n > 1, n) & (pos >> np.uint32(31) == 0)
        ref, pos = np.append(ref[again], pick("ref", np.uint32, True)), np.append(pos[again], pick("pos", np.uint32, True))
        bucket = (ref & np.uint32(buckets - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ref, pos, bucket = ref[order], pos[order], bucket[order]
        return rows(FLAGS, [(b, planes(ref[s]), planes(pos[s])) for b, s in by_part(bucket)])

    return stage


def ordered(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, doc_ids (null: last) and uids of a bucket's documents."""
    doc = table.column("doc_id").fill_null(LAST).to_numpy()
    return text_bytes(table.column("text")), doc, table.column("uid").to_numpy()


def check_bits(uid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What tells rows of one doc_id apart: 32 bits of their hash, all 64 where the doc_id is null, which many rows may share."""
    full = uid.view(np.uint64)
    return np.where(doc == LAST, full, full >> U64(32))


def window_stage(parts: int, width: int):
    """The windows around repeated anchors, each distinct sequence once, with its first occurrence in the bucket."""
    bits = parts.bit_length() - 1
    reach = PERIOD - 1

    def stage(docs, flags):
        if not flags.num_rows or not docs.num_rows:
            return rows(WINDOWS, [])
        bucket = flags.column("bucket")[0].as_py()
        ref, pos = joined(flags.column("ref").to_pylist(), np.uint32), joined(flags.column("pos").to_pylist(), np.uint32)
        order = np.argsort(ref, kind="stable")
        ref, pos = ref[order], pos[order].astype(np.int64)
        texts, doc, uid = ordered(docs)
        short = (uid & 0xFFFFFFFF).astype(np.uint32)
        lo, hi = np.searchsorted(ref, short, "left"), np.searchsorted(ref, short, "right")
        kept = []
        for d in np.lexsort((uid, doc)):
            if hi[d] == lo[d]:
                continue
            h, _ = word_hashes([texts[d]], lower=False)
            n = len(h) - width + 1
            if n <= 0:
                continue
            edge = np.zeros(n + reach + 2, np.int64)
            p = pos[lo[d] : hi[d]]
            p = p[p < len(h)]
            np.add.at(edge, np.maximum(p - reach, 0), 1)
            np.add.at(edge, np.minimum(p, n - 1) + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            if len(at):
                kept.append((window_hashes(h, width)[at], (window_hashes(h, width, OTHER_BASE)[at] >> U64(32)).astype(np.uint32), np.full(len(at), doc[d]), np.full(len(at), check_bits(uid[d : d + 1], doc[d : d + 1])[0]), at.astype(np.uint32)))
        if not kept:
            return rows(WINDOWS, [])
        key, more, doc, ref, pos = (np.concatenate(x) for x in zip(*kept))
        shared = len(np.unique(docs.column("doc_id").to_numpy(zero_copy_only=False))) < docs.num_rows
        order = np.lexsort((pos, doc, more, key)) if shared else np.argsort(key, kind="stable")
        key, more, doc, ref, pos = (x[order] for x in (key, more, doc, ref, pos))
        starts, n = runs(key, more)
        # what follows the first of a sequence starts later, unless it is the same place of an equal row
        lead = np.repeat(starts, n)
        behind = (doc != doc[lead]) | (pos > pos[lead])
        same = ~behind & (lead != np.arange(len(key))) & (ref != ref[lead])
        first = np.zeros(len(key), bool)
        first[starts] = True
        part = (key >> U64(64 - bits)).astype(np.int64)
        out = []
        asks = np.flatnonzero(first | same)
        for p, s in by_part(part[asks]):
            i = asks[s]
            out.append((p, bucket, False, planes(key[i]), planes(more[i]), planes(doc[i]), planes(ref[i]), planes(pos[i])))
        later = np.flatnonzero(behind)
        for i in range(0, len(later), BLOCK):
            i = later[i : i + BLOCK]
            out.append((int(key[i[0]] % U64(parts)), bucket, True, b"", b"", planes(doc[i]), planes(ref[i]), planes(pos[i])))
        return rows(WINDOWS, out)

    return stage


def later_stage(table):
    """The windows of one key range to those that aren't the first of their sequence."""
    passing = table.column("passing").to_pylist()
    got = {c: table.column(c).to_pylist() for c in ("bucket", "key", "more", "doc", "ref", "pos")}
    kinds = {"key": np.uint64, "more": np.uint32, "doc": np.int64, "ref": np.uint64, "pos": np.uint32}
    out = [tuple(got[c][i] for c in ("bucket", "doc", "ref", "pos")) for i, p in enumerate(passing) if p]
    asks = [i for i, p in enumerate(passing) if not p]
    key, more, doc, ref, pos = (joined([got[c][i] for i in asks], kinds[c]) for c in ("key", "more", "doc", "ref", "pos"))
    bucket = np.repeat([got["bucket"][i] for i in asks], [len(got["key"][i]) // 8 for i in asks]) if asks else np.empty(0, np.int64)
    order = np.lexsort((pos, doc, more, key))
    key, more, doc, ref, pos, bucket = (x[order] for x in (key, more, doc, ref, pos, bucket))
    lead = np.repeat(*runs(key, more))
    i = np.flatnonzero((doc != doc[lead]) | (pos != pos[lead]))
    i = i[np.argsort(bucket[i], kind="stable")]
    for b, s in by_part(bucket[i]):
        out.append((b, planes(doc[i[s]]), planes(ref[i[s]]), planes(pos[i[s]])))
    return rows(LATER, out)


def removal_stage(width: int):
    """Documents of a bucket with the words under later windows removed."""

    def stage(docs, later):
        doc_of = joined(later.column("doc").to_pylist(), np.int64)
        ref, pos = joined(later.column("ref").to_pylist(), np.uint64), joined(later.column("pos").to_pylist(), np.uint32)
        order = np.lexsort((ref, doc_of))
        doc_of, ref, pos = doc_of[order], ref[order], pos[order].astype(np.int64)
        texts, doc, uid = ordered(docs)
        check = check_bits(uid, doc)
        lo, hi = np.searchsorted(doc_of, doc, "left"), np.searchsorted(doc_of, doc, "right")
        n_words, n_removed, kept_texts, digests = [], [], [], []
        for d, text in enumerate(texts):
            words = text.split() if text else []
            at = pos[lo[d] : hi[d]][ref[lo[d] : hi[d]] == check[d]]
            gone = 0
            kept = text
            if len(at):
                edge = np.zeros(len(words) + width + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                stays = np.cumsum(edge)[: len(words)] == 0
                gone = len(words) - int(stays.sum())
                words_kept = [words[i] for i in np.flatnonzero(stays)]
                kept = b" ".join(words_kept)
                digest = hashlib.sha256(kept)
            else:
                digest = hashlib.sha256(b" ".join(words))
            n_words.append(len(words))
            n_removed.append(gone)
            kept_texts.append(kept)
            digests.append(digest.hexdigest())
        return pa.table({"rest": docs.column("rest"), "kept": pa.array(kept_texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return stage


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row: rest (a struct of all columns but text), kept (the text; if words were removed, the others joined by one space), n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    small_batches(docs.sparkSession)
    parts, buckets = ranges_for(docs), ranges_for(docs, 4 << 20)
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    numbered = docs.select("doc_id", "text", rest, F.xxhash64("doc_id", "text").alias("uid"))
    anchors = numbered.select("uid", "text").mapInArrow(frugal(anchor_stage(parts, width)), ANCHORS)
    flags = anchors.groupBy("part").applyInArrow(frugal_group(repeated_stage(buckets)), FLAGS)
    placed = numbered.withColumn("bucket", F.col("uid").bitwiseAND(buckets - 1).cast("int")).repartition("bucket")
    windows = placed.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(frugal_groups(window_stage(parts, width)), WINDOWS)
    later = windows.groupBy("part").applyInArrow(frugal_group(later_stage), LATER)
    schema = T.StructType([T.StructField("rest", numbered.schema["rest"].dataType), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return placed.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(frugal_groups(removal_stage(width)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The same rows and columns with repeated windows cut out of text; n_chars, where there is one, follows."""
    done = dedup_substrings(docs)
    columns = [F.col("kept").alias("text") if c == "text" else F.coalesce(F.length("kept").cast("long"), F.col("rest.n_chars")).alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns]
    return done.select(*columns)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(0, len(ws) - 19)) AS p, ws FROM d WHERE len(ws) >= 20),
w AS (SELECT doc_id, p, sha256(array_to_string(ws[p + 1:p + 20], ' ')) AS k FROM t),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(range(0, len(ws))) AS q, unnest(ws) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.q = g.q GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
