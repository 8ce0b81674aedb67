"""A corpus, stage by stage: every stage is one operator over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow.llm.common import stored, table
from tierflow.llm.decontaminate import decontaminate
from tierflow.llm.lines import drop_repeated_chunks
from tierflow.llm.mixing import mix
from tierflow.llm.quality import resample
from tierflow.llm.queries import MIX_BLOCK_ROWS, MIX_WEIGHTS
from tierflow.llm.similar import first_of_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the rest go."""
    return resample(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier; every document stays."""
    cut = drop_repeated_chunks(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint"))
    return cut.withColumn("n_chars", F.coalesce(length, "n_chars")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that share 0.8 of their shingles."""
    return first_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.where("n_hit = 0").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in an order that meets the source weights."""
    return mix(docs, MIX_WEIGHTS, MIX_BLOCK_ROWS)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
]
#: XXH64 and the Gumbel draw have no counterpart in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
