"""Which names contain which patterns, for many patterns at once, by positional postings of the names' character runs.

A pattern of three characters and more is looked up by its rarest run of three; shorter ones by runs of their own length.
A posting tells where the run stands in a name, so the pattern is compared with that one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .search import small

#: Characters of the longest runs.
GRAM = 3


def runs(text: Column, size: Column | int) -> Column:
    """The runs of `size` characters of a text, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))).otherwise(F.array().cast("array<string>"))


def name_postings(names: DataFrame, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gram, at, low, name): each run of one to GRAM characters of each different name, in lower case, with its place from 0; with
    `by` (columns) of each different name of a group, such as a file."""
    given = names.select(*by, F.col(name).alias("name")).where("name is not null").distinct().withColumn("low", F.lower("name"))
    sized = given.withColumn("size", F.explode(F.array(*(F.lit(n) for n in range(1, GRAM + 1)))))
    return sized.select(*by, "name", "low", F.posexplode(runs(F.col("low"), F.col("size"))).alias("at", "gram"))


def holding(patterns: DataFrame, postings: DataFrame, pattern: str = "pattern", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pattern, name): the different names that contain each different pattern, ignoring case; with `by` those of the pattern's
    group. Empty patterns are in no name here.

    Spark takes exploded rows for no more than their source and would broadcast the postings of many names, so it is told to
    shuffle them where the patterns are too many to be broadcast themselves."""
    given = stored(patterns.select(*by, F.col(pattern).alias("pattern")).where("pattern <> ''").distinct().withColumn("wanted", F.lower("pattern")))
    grams = given.select(*by, "pattern", "wanted", F.posexplode(runs(F.col("wanted"), F.least(F.length("wanted"), F.lit(GRAM)))).alias("offset", "gram"))
    many = postings.hint("merge")
    # frequencies of the runs that are asked for; a run that no name has ends the pattern here
    asked = stored(grams.select(*by, "gram").distinct())
    often = many.select(*by, "gram").hint("merge").join(small(asked), [*by, "gram"]).groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rated = grams.join(often, [*by, "gram"], "left").groupBy(*by, "pattern", "wanted").agg(F.min_by(F.struct("gram", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("rarest"))
    probes = stored(rated.select(*by, "pattern", "wanted", "rarest.gram", "rarest.offset"))
    # found once: at the first of its places in a name
    first = (F.col("at") >= F.col("offset")) & (F.position(F.col("wanted"), F.col("low")) == F.col("at") - F.col("offset") + 1)
    return many.join(small(probes), [*by, "gram"]).where(first).select(*by, "pattern", "name")


def symbols_holding(patterns: DataFrame, symbols: DataFrame, query: str = "query_id", pattern: str = "pattern") -> DataFrame:
    """(query, the symbols' columns) for patterns (query, pattern): the symbols whose name contains the pattern, ignoring case."""
    found = holding(patterns, name_postings(symbols), pattern).withColumnRenamed("pattern", "__pattern")
    named = patterns.select(query, F.col(pattern).alias("__pattern")).join(found, "__pattern").drop("__pattern")
    return named.join(symbols, "name")
