"""Paths of rows that name their parent, by pointer jumping: each round doubles the steps that a row knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def paths(rows: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name", sep: str = ".") -> DataFrame:
    """(id, root, depth, path) of rows (id, parent, name): the topmost row, the steps to it, and the names from it down. A parent that isn't among
    the rows counts as none. Rows of a cycle, or under one, have no root, depth or path. Ids must be unique.

    Rows under which none stands, which are most, take no part in the rounds: all rows read their parent's result at the end. Each round takes a row as far again as it came; rows that have arrived take no part in the next. When a round brings no row to
    its top none will arrive any more, as a row's ancestors arrive before it: what is left is in a cycle or under one."""
    given = rows.select(F.col(id).alias("id"), F.col(parent).alias("up"), F.coalesce(F.col(name), F.lit("")).alias("path"))
    parents = given.select(F.col("up").alias("id")).where("id is not null").distinct()
    inner = stored(given.join(parents, "id", "left_semi"))
    known = inner.select(F.col("id").alias("up")).withColumn("is", F.lit(True))
    start = inner.join(known, "up", "left").select("id", F.when(F.col("is"), F.col("up")).alias("up"), "path")
    # `up` is the first row above that `path` lacks, `depth` the rows of `path` but this one
    done = stored(start.where("up is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), "path"))
    moving = stored(start.where("up is not null").select("id", "up", F.lit(1).cast("long").alias("steps"), "path"))
    while True:
        over = done.select(F.col("id").alias("up"), "root", "depth", F.col("path").alias("above"))
        new = stored(moving.join(over, "up").select("id", "root", (F.col("steps") + F.col("depth")).alias("depth"), F.concat("above", F.lit(sep), "path").alias("path")))
        if not new.limit(1).count():
            break
        done = done.unionByName(new)
        left = moving.join(new.select("id"), "id", "left_anti")
        over = left.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("path").alias("above"))
        # a row whose next one has just arrived waits for the next round
        far = left.join(over, "up", "left")
        moving = stored(far.select("id", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.when(F.col("up2").isNull(), F.col("path")).otherwise(F.concat("above", F.lit(sep), "path")).alias("path")))
    above = inner.select("id").join(done, "id", "left").select(F.col("id").alias("up"), "root", "depth", F.col("path").alias("above"), F.lit(True).alias("is"))
    below = given.join(above, "up", "left")
    follows = lambda value, top: F.when(F.col("is"), value).otherwise(top)
    return below.select("id", follows(F.col("root"), F.col("id")).alias("root"), follows(F.col("depth") + 1, F.lit(0).cast("long")).alias("depth"), follows(F.concat("above", F.lit(sep), "path"), F.col("path")).alias("path"))
