"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

`build_index` stores one posting (uid, doc_id, term, pos) per occurrence in the corpus of a term of the test items, and
one end marker per document whose position is the number of its words. Terms that no item has cannot take part in a
match, so leaving them out loses nothing. `phrase_matches` starts from the rarest term of each test phrase: its list,
shifted by the term's offset, gives candidate starts, the list of the second rarest term thins them, and the lists of
the documents that are left must then hold every term of the phrase. With `slop` a term may stand up to so many words
off its place (proximity).

Cases: a null text has no words (n_words 0, nothing hit); an empty one likewise. Repeated document rows each get a
row. Null doc_ids are kept. Items with a null id or without words are left out; item rows that repeat an id count as
one item with the windows of all. Other columns of the inputs, whatever their names, are ignored. Empty tables give
empty or all-clean results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, with_uid

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if at least this share of its words (one in so many) is hit.
ONE_IN = 20
#: Term of the end marker; no word is empty.
END = ""
#: Sides up to so many rows (some MB) are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 200_000


def words(text):
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(phrase, terms, item_ids) of the distinct windows of `width` words; shorter items are one window."""
    w = items.where("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - F.lit(width), F.lit(0)))
    terms = w.select("item_id", "ws", F.explode(starts).alias("i")).select("item_id", F.slice("ws", F.col("i") + 1, F.lit(width)).alias("terms"))
    return terms.withColumn("phrase", F.array_join("terms", " ")).groupBy("phrase", "terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored postings of the terms in `vocabulary` (column term), with an end marker for each document, which alone
    carries a hash of the text (key). Rows are numbered (uid) in the one scan that is stored; the numbers mean nothing outside the index."""
    tokens = with_uid(docs.select("doc_id", "text")).withColumn("key", F.xxhash64("text")).select("uid", "doc_id", "key", F.posexplode(F.concat(F.coalesce(words(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(END)))).alias("pos", "term"))
    wanted = vocabulary.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct()
    return stored(tokens.join(sized(wanted), "term").select("uid", "doc_id", "term", "pos", F.when(F.col("term") == END, F.col("key")).alias("key")))


def phrase_matches(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(uid, phrase, start, n_terms): where every term of a phrase (columns phrase, terms) stands at its offset from start, up to slop words off."""
    spots = phrases.select("phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
    heard = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("cf"))
    ranked = spots.join(heard, "term").groupBy("phrase", "n_terms").agg(F.sort_array(F.collect_list(F.struct("cf", "offset", "term"))).alias("by_cf")).where("size(by_cf) = n_terms")
    ranked = stored(ranked)
    rarest = ranked.select("phrase", F.col("by_cf")[0]["term"].alias("term"), F.col("by_cf")[0]["offset"].alias("offset"))
    found = index.join(sized(rarest), "term").select("uid", "phrase", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    second = ranked.where("n_terms > 1").select("phrase", F.col("by_cf")[1]["term"].alias("term"), F.col("by_cf")[1]["offset"].alias("offset"))
    near = index.join(sized(second), "term").select("uid", "phrase", (F.col("pos") - F.col("offset")).alias("start"))
    if slop:
        near = near.select("uid", "phrase", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start"))
    near = near.distinct() if slop else near
    single = found.join(sized(ranked.where("n_terms = 1").select("phrase")), "phrase", "left_semi")
    found = stored(found.join(near, ["uid", "phrase", "start"], "left_semi").unionByName(single))
    lists = index.join(sized(found.select("uid").distinct()), "uid", "left_semi").select("uid", "term", "pos")
    probes = found.join(spots, "phrase").select("uid", "phrase", "start", "n_terms", "offset", "term", (F.col("start") + F.col("offset")).alias("pos"))
    if slop:
        probes = probes.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    held = probes.join(lists, ["uid", "term", "pos"]).groupBy("uid", "phrase", "start", "n_terms").agg((F.count_distinct("offset") if slop else F.count("*")).alias("n"))
    return held.where("n = n_terms").drop("n")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """For each row of docs: doc_id, key (a hash of the text), n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    windows = stored(item_windows(items, width))
    index = build_index(docs, windows.select(F.explode("terms").alias("term")).distinct())
    hits = stored(phrase_matches(index, windows))
    covered = hits.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("pos")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    of_items = hits.select("uid", "phrase").distinct().join(windows.select("phrase", F.explode("item_ids").alias("item_id")), "phrase").groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = index.where(F.col("term") == END).select("uid", "doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    out = reduce(lambda a, b: a.join(b, "uid", "left"), (covered, of_items), rows)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("uid", "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, in whatever number they repeat.

    Contamination is a matter of the text alone, so rows are found again by doc_id (null is one too) and a hash of the
    text: nothing depends on how a scan is split. Null and empty texts stay."""
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"))
    bad = stored(decontaminate(docs, items).where("contaminated").select("doc_id", "key").distinct())
    return given.join(sized(bad), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("key")), "left_anti").select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(ws) - 13, 0) + 1), lambda k: array_to_string(ws[k + 1:k + 13], ' '))) AS phrase, least(len(ws), 13) AS n FROM i WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM w),
t AS (SELECT uid, n, unnest(range(0, len(ws) - n + 1)) AS p, ws FROM d, lens WHERE len(ws) >= n),
m AS (SELECT uid, p, t.n, w.item_id FROM (SELECT uid, n, p, array_to_string(ws[p + 1:p + n], ' ') AS phrase FROM t) t JOIN w ON w.phrase = t.phrase AND w.n = t.n),
h AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(p, p + n)) AS q FROM m) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM m) GROUP BY uid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN s USING (uid)
"""
