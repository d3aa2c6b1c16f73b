"""A corpus pipeline of five stages, in this order: rows of a known language, one row of each group of near-copies,
repeated passages cut out, contaminated rows dropped, token ids. Each stage works on all that its predecessor kept; all
but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snipspark.llm import decontaminate, jaccard_join, langid, pieces, substrings
from snipspark.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the models identify, with that language as lang; null, empty and letterless texts go."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies, that of the least doc_id; rows without words stay."""
    return jaccard_join.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words under passages that also start earlier; an emptied text stays as an empty one."""
    return substrings.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate, however often they repeat."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip and ids of every row; null and empty texts have no tokens."""
    return pieces.tokenised(docs, tokens=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: No SQL: the first stage predicts with a fitted model, the last follows a tokenizer's model. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
