"""Fill-in-the-middle: each text becomes prefix, suffix and middle in another order, cut at code points by a hash of its id.

An automaton reads UTF-8 bytes. Its state says how many bytes of a code point are due and how much of a marker was
read. A chunk doesn't know the state it begins in, so it gives for each state the one it ends in, the code points it
completes and the markers it finds: these summaries compose associatively. Chunks of a task are read in step, two bytes at a
time. A text longer than a piece is dealt over tasks as pieces, whose composed summaries tell each piece its
entry state and the code points before it; the task of the piece in which a cut falls then selects its byte.

Cases: a null text counts as an empty one (n 0, plain, empty output); a null doc_id as an empty string in the hash. Equal
rows give equal rows. Texts are valid UTF-8, as Spark's strings are. Other columns travel in `rest` untouched, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, text_bytes
from .decontaminate import sized

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk that is read in step with others, and of a piece of a long text.
CHUNK, PIECE = 4096, 256 << 10
#: Chunks read at once.
LANES = 2048

#: States: nothing due; "<" was read; "<" and a letter of a marker; one, two, three bytes due.
STATES, PAD = 6, 0xFF
POINT, MARK = 1 << 3, 1 << 19


def byte_table() -> np.ndarray:
    """[state, byte] -> next state, a code point completed, a marker completed. PAD changes nothing."""
    t = np.zeros((STATES, 256), np.uint32)
    t[:, :0x80] = POINT  # ASCII completes a code point and leads to state 0
    t[:3, 0x80:0xC0] = POINT  # a stray byte counts as one
    for due in (1, 2, 3):
        t[2 + due, 0x80:0xC0] = POINT if due == 1 else 1 + due
    t[:, 0xC0:0xE0], t[:, 0xE0:0xF0], t[:, 0xF0:0xF8] = 3, 4, 5
    t[:, ord("<")] = POINT + 1
    for letter in b"PSM":
        t[1, letter] = POINT + 2
    t[2, ord(">")] = POINT + MARK
    t[:, PAD] = np.arange(STATES)
    return t


def pair_table() -> np.ndarray:
    """[state, two bytes] -> the same for both, little end first."""
    one = byte_table()
    pair = np.arange(1 << 16)
    first = one[:, pair & 0xFF]
    second = one[(first & 7), (pair >> 8)[None, :]]
    return ((first & ~np.uint32(7)) + second).astype(np.uint32).reshape(-1)


PAIRS = pair_table()


def scanned(chunks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk and entry state: end state, code points and markers completed."""
    ends, points, marks = (np.empty((len(chunks), STATES), np.int64) for _ in range(3))
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        steps = (size[lanes] + 1) // 2
        whole = np.full((len(lanes), 2 * int(steps[0])), PAD, np.uint8)
        for row, i in zip(whole, lanes):
            row[: size[i]] = np.frombuffer(chunks[i], np.uint8)
        pairs = np.ascontiguousarray(whole.view("<u2").T)
        active = np.searchsorted(-steps, -np.arange(len(pairs)), "left")  # lanes that last longer than so many steps
        state = np.tile(np.arange(STATES, dtype=np.uint32), (len(lanes), 1))
        total = np.zeros((len(lanes), STATES), np.uint32)
        for step, n in zip(pairs, active):
            got = PAIRS[(state[:n] << np.uint32(16)) | step[:n, None]]
            state[:n] = got & np.uint32(7)
            total[:n] += got >> np.uint32(3)
        ends[lanes], points[lanes], marks[lanes] = state, total & np.uint32(0xFFFF), total >> np.uint32(16)
    return ends, points, marks


def composed(f: tuple, g: tuple) -> tuple:
    """The summary of f's bytes followed by g's; associative."""
    ends, points, marks = f
    return g[0][ends], points + g[1][ends], marks + g[2][ends]


def chunked(text: bytes) -> list:
    view = memoryview(text)
    return [view[i : i + CHUNK] for i in range(0, len(view), CHUNK)]


def selected(chunk, entry: int, k: int) -> int:
    """The bytes of a chunk, entered in that state, up to the end of its k-th completed code point."""
    if k <= 0:
        return 0
    b = np.frombuffer(chunk, np.uint8)
    begins = np.flatnonzero((b & 0xC0) != 0x80)
    ends = begins + 1 + (b[begins] >= 0xC0) + (b[begins] >= 0xE0) + (b[begins] >= 0xF0)
    due = max(entry - 2, 0)
    if due:
        k -= 1
        if not k:
            return due
    return int(ends[k - 1])


def located(text: bytes, at: int, summaries: list, cut: int) -> int:
    """The byte of a code point cut in a text whose chunks' summaries begin at `at`."""
    state = before = 0
    for i, (ends, points) in enumerate(summaries):
        if cut <= before + points[state]:
            return i * CHUNK + selected(text[i * CHUNK : (i + 1) * CHUNK], state, cut - before)
        state, before = ends[state], before + points[state]
    return len(text)


def form_of(n: int, marks: int, h3: int, h4: int, plain: int, spm: int) -> str:
    if not n or marks or h3 % 100 >= plain:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def written(form: str, text: bytes, lo: int, hi: int) -> bytes:
    p, s, m = text[:lo], text[hi:], text[lo:hi]
    order = ((SUFFIX, s), (PREFIX, p)) if form == "spm" else ((PREFIX, p), (SUFFIX, s))
    return b"".join(x for mark, part in (*order, (MIDDLE, m)) for x in (mark.encode(), part))


def transformed_stage(plain: int, spm: int):
    """Texts to their transformed forms; those with `found` were cut by the tasks of their pieces."""

    def stage(batches):
        for b in batches:
            texts = [t or b"" for t in text_bytes(b.column("text"))]
            h, found = b.column("h").to_pylist(), b.column("found").to_pylist()
            own = [i for i, f in enumerate(found) if f is None]
            parts = [chunked(texts[i]) for i in own]
            ends, points, marks = (x.tolist() for x in scanned([c for p in parts for c in p]))
            out, at = [None] * len(texts), 0
            for i, p in zip(own, parts):
                state = n = mark = 0
                for j in range(at, at + len(p)):
                    n, mark, state = n + points[j][state], mark + marks[j][state], ends[j][state]
                form, cuts = form_of(n, mark, *h[i][2:], plain, spm), (None, None, None, None)
                if form != "plain":
                    lo, hi = sorted((h[i][0] % (n + 1), h[i][1] % (n + 1)))
                    summaries = list(zip(ends[at : at + len(p)], points[at : at + len(p)]))
                    cuts = lo, hi, located(texts[i], at, summaries, lo), located(texts[i], at, summaries, hi)
                out[i] = (n, form, *cuts)
                at += len(p)
            for i, f in enumerate(found):
                if f is not None:
                    out[i] = tuple(f[c] for c in ("n", "form", "lo", "hi", "lo_at", "hi_at"))
            text = [t if o[1] == "plain" else written(o[1], t, o[4], o[5]) for t, o in zip(texts, out)]
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([None if o[2] is None else o[3] - o[2] for o in out], pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                ["rest", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return stage


def piece_stage(batches):
    """Pieces of long texts to their summaries."""
    for b in batches:
        found = []
        for piece in b.column("piece").to_pylist():
            whole = (np.arange(STATES), np.zeros(STATES, np.int64), np.zeros(STATES, np.int64))
            for summary in zip(*scanned(chunked(piece))):
                whole = composed(whole, summary)
            found.append(whole)
        arrays = [pa.array([list(map(int, f[i])) for f in found], pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column("long_key"), b.column("at"), b.column("h"), *arrays], ["long_key", "at", "h", "ends", "points", "marks"])


PLACES = "long_key string, n long, form string, lo long, hi long, first boolean, at int, entry int, k long"


def entry_stage(plain: int, spm: int):
    """The summaries of one long text to the pieces in which its cuts fall, each with its entry state and code points to pass. A text has
    no more pieces than a row has room for."""

    def stage(table):
        got = {at: (h, e, p, m) for at, h, e, p, m in zip(*(table.column(c).to_pylist() for c in ("at", "h", "ends", "points", "marks")))}
        state = n = mark = 0
        entries = []
        for at in sorted(got):
            h, ends, points, marks = got[at]
            entries.append((at, state, n))
            n, mark, state = n + points[state], mark + marks[state], ends[state]
        form = form_of(n, mark, *h[2:], plain, spm)
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1))) if form != "plain" else (None, None)
        out = []
        for first, cut in ((True, lo), (False, hi)):
            at, entry, before = next(e for e in reversed(entries) if cut is None or e[2] < cut or e[0] == 0)
            out.append((n, form, lo, hi, first, at, entry, cut - before if cut is not None else None))
        names = ["n", "form", "lo", "hi", "first", "at", "entry", "k"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({"long_key": pa.array([table.column("long_key")[0].as_py()] * 2, pa.string())} | {c: pa.array(v, t) for c, v, t in zip(names, zip(*out), kinds)})

    return stage


def cut_stage(piece_bytes: int):
    """Pieces with a cut to the byte of the cut in the whole text."""

    def stage(batches):
        for b in batches:
            at = []
            for piece, no, entry, k in zip(*(b.column(c).to_pylist() for c in ("piece", "at", "entry", "k"))):
                at.append(None if k is None else no * piece_bytes + selected(piece, entry, k))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("long_key", "n", "form", "lo", "hi", "first")), pa.array(at, pa.int64())], ["long_key", "n", "form", "lo", "hi", "first", "byte"])

    return stage


def long_cuts(long: DataFrame, piece: int, plain: int, spm: int) -> DataFrame:
    """(long_key, found) of the long texts, cut piece by piece in as many tasks as they have pieces for."""
    raw = F.encode("text", "utf-8")
    parts = F.expr(f"transform(sequence(0, cast((octet_length(raw) - 1) div {piece} as int)), i -> substring(raw, i * {piece} + 1, {piece}))")
    pieces = stored(long.select("long_key", "h", raw.alias("raw")).select("long_key", "h", F.posexplode(parts).alias("at", "piece")))
    summaries = pieces.mapInArrow(piece_stage, "long_key string, at int, h array<long>, ends array<long>, points array<long>, marks array<long>")
    places = summaries.groupBy("long_key").applyInArrow(entry_stage(plain, spm), PLACES)
    cut = pieces.drop("h").join(sized(stored(places)), ["long_key", "at"]).mapInArrow(cut_stage(piece), "long_key string, n long, form string, lo long, hi long, first boolean, byte long")
    byte = lambda first: F.max(F.when(F.col("first") == first, F.col("byte")))
    ends = cut.groupBy("long_key").agg(*(F.first(c).alias(c) for c in ("n", "form", "lo", "hi")), byte(True).alias("lo_at"), byte(False).alias("hi_at"))
    return ends.select("long_key", F.struct("n", "form", "lo", "hi", "lo_at", "hi_at").alias("found"))


def fill_in_middle(docs: DataFrame, piece: int = PIECE, plain: int = 90, spm: int = 20, salt: str = "1:") -> DataFrame:
    """For each row: rest (a struct of all columns but text), n (code points), form (plain, psm, spm), prefix_chars and
    middle_chars (null if plain), output (the transformed text)."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.array(*(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))).alias("h")
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    given = docs.select(rest, "text", digest.alias("digest")).select("rest", "text", h)
    # a long text is known by its hashes and digest: equal rows are cut once
    key = F.when(F.octet_length("text") > piece, F.concat_ws(":", F.array_join(F.col("h").cast("array<string>"), ":"), F.sha2("text", 256)))
    given = given.withColumn("long_key", key)
    found = sized(stored(long_cuts(given.where(F.octet_length("text") > piece), piece, plain, spm)))
    joined = given.join(found, "long_key", "left").select("rest", "text", "h", "found")
    schema = T.StructType([T.StructField("rest", given.schema["rest"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return joined.mapInArrow(transformed_stage(plain, spm), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. No text that is cut holds a marker, so the first of each kind is ours."""
    skip = lambda c, n: F.substr(c, F.lit(n + 1))
    first = lambda c, mark: F.substring_index(c, mark, 1)
    body, second = skip(output, 3), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.when(form == "spm", first(body, PREFIX)).otherwise(first(body, SUFFIX))
    after = F.substr(body, F.char_length(one) + F.char_length(second) + 1)
    two = first(after, MIDDLE)
    middle = F.substr(after, F.char_length(two) + 4)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    return done.select(F.col("rest.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
x AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM x),
p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
