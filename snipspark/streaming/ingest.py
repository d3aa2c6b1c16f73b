"""Continuous indexing: files that appear under a folder are parsed as they come, as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..sources import parsing
from ..sources.files import LARGEST

BINARY = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """(path, hash, size, language, content) of new files; bytes that aren't UTF-8 become U+FFFD. Spark's stream of
    files leaves out names that begin with a dot or an underscore; a run of the index picks them up."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    text = raw.where(F.col("length") <= LARGEST).withColumn("language", language_of(F.col("path"))).where("language <> 'unknown'")
    return text.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), "language", F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def chunk_stream(files: DataFrame) -> DataFrame:
    """The chunks of each file as it arrives; stateless, so it may append to any sink."""
    return parsing.table(parsing.parse(files), "chunks")
