"""Quality rules: a table of thresholds compiled into one projection of built-in functions, without shuffles.

`features` adds the measures of a text to its row; `RULES` is the table (measure, relation, bound); `verdict` turns the
table into a single boolean column. Repeated 3-word windows are found within the row: each window's hash and position
are packed in one number (the position takes as many bits as the text needs), one sort of primitive numbers brings
equal windows together, and neighbours in that order with equal hashes are compared word by word. So a text of a
million words costs one sort, not its square.

Cases: null and empty texts have no words, all counts are 0, and they fail. Repeated rows each get a row; nulls in
other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols, and the white space that separates words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the and of to in a is that it for as with by on be at or an are was from der die das und in zu den mit von für ist des im nicht ein eine le la les de des et en un une du que qui dans pour par sur el los las y del una por con no se su para al lo como".split()
#: The table: measure, "min" or "max", bound. A text is kept if it meets every line.
RULES = [
    ("n_words", "min", 50),
    ("repeat_percent", "max", 50),
    ("n_words", "max", 1_000_000),
    ("mean_word_chars", "min", 2.0),
    ("mean_word_chars", "max", 20.0),
    ("symbol_ratio", "max", 0.1),
    ("stop_words", "min", 2),
    ("dup_line_ratio", "max", 0.5),
]
#: Lines of the table that make up base_failed.
BASE = RULES[:2]


def occurrences(text, characters: str):
    """How often any of some ASCII characters stands in the text: by what the text shrinks without them."""
    return F.octet_length(text) - F.octet_length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the measures, a row for each row."""
    text = F.coalesce("text", F.lit(""))
    stop = F.array(*(F.lit(w) for w in sorted(set(STOP_WORDS))))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.select("doc_id", words.alias("ws"), lines.alias("ls"), occurrences(text, SYMBOLS).cast("long").alias("n_symbols"), (F.length(text) - occurrences(text, SPACES)).cast("long").alias("word_chars"))
    # one number for each window of three words: hash above, position below
    low = F.col("low")
    masked = split.withColumn("low", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("ws") + 1.0))).cast("bigint") - 1)
    packed = F.when(F.size("ws") > 2, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))))
    sorts = masked.withColumn("s", F.coalesce(packed, F.array().cast("array<bigint>")))
    word = lambda x, k: F.get("ws", (x.bitwiseAND(low) + k).cast("int"))
    equal = lambda x, y: (x.bitwiseOR(low) == y.bitwiseOR(low)) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    again = F.filter("s", lambda x, j: equal(x, F.get("s", j - 1)) | equal(x, F.get("s", j + 1)))
    places = sorts.withColumn("p", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(low))))
    # each window covers three words, or fewer if the next one begins before its end
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("p", j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.size("ws").cast("long")
    counted = places.select(F.inline(F.array(F.struct(  # a generator: filters on the verdict stay above it and don't repeat all this
        "doc_id", size.alias("n_words"), "word_chars", "n_symbols", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"), F.size(F.array_intersect(F.transform(F.slice("ws", 1, F.size("ws")), F.lower), stop)).cast("long").alias("stop_words"),
    ))))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select("*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "word_chars").alias("symbol_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"))


#: Measures that are shares in percent, as numerator and denominator: their lines are compared in whole numbers.
PERCENT = {"repeat_percent": ("n_repeat_words", "n_words")}


def verdict(rules=RULES):
    """True where every line of the table holds."""
    sides = lambda m, bound: (100 * F.col(PERCENT[m][0]), bound * F.col(PERCENT[m][1])) if m in PERCENT else (F.col(m), F.lit(bound))
    line = lambda kind, a, b: a >= b if kind == "min" else a <= b
    return reduce(lambda a, b: a & b, [line(kind, *sides(m, bound)) for m, kind, bound in rules])


def quality(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """doc_id, the measures, base_failed (a line of `base` doesn't hold) and kept (all lines of both tables hold)."""
    return features(docs).withColumn("base_failed", ~verdict(base)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
t AS (SELECT uid, unnest(range(0, len(ws) - 2)) AS p, ws FROM d WHERE len(ws) >= 3),
g AS (SELECT uid, p, count(*) OVER (PARTITION BY uid, array_to_string(ws[p + 1:p + 3], ' ')) AS n FROM t),
r AS (SELECT uid, count(DISTINCT q) AS n FROM (SELECT uid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY uid),
l AS (SELECT uid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
 len(ls) AS n_lines, (SELECT count(DISTINCT lower(w)) FROM (SELECT unnest(ws) AS w) WHERE lower(w) IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))})) AS stop_words
 FROM d JOIN l USING (uid) LEFT JOIN r USING (uid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND n_words <= 1000000 AND word_chars / n_words::DOUBLE BETWEEN 2 AND 20 AND n_symbols / word_chars::DOUBLE <= 0.1 AND stop_words >= 2 AND n_dup_lines / n_lines::DOUBLE <= 0.5 AS kept
FROM b
"""
