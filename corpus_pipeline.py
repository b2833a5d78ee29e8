"""A corpus pipeline of five operators: quality rules, line dedup, near-dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return the
columns of documents; the last has the columns of OUTPUT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.llm import bpe, line_dedup, mixing, quality, simhash
from fiberlake.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OUTPUT = ("doc_id", "source", "n_tokens", "input_ids")
#: No source is repeated more often than this; none loses a document.
MOST_REPEATS = 2.0
MIX_KEY = 17


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document alone; n_chars follows the text."""
    return line_dedup.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to MOST_REPEATS times, in the smallest mixture that holds every document; shares are
    of the tokens that the next stage makes."""
    return mixing.mixed(docs, repeats=MOST_REPEATS, key=MIX_KEY, vocabulary=bpe.default_path())


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs.select("doc_id", "source", "text")).withColumn("n_tokens", F.size("input_ids").cast("long")).select(*OUTPUT)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the posterior, the wide fingerprints or the automaton; tests/llm/test_pipeline.py holds each stage
#: against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
