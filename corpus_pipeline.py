"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a table with the columns of documents;
the last returns the token files' digest.  Models and queries that SQL can't express
are among the stages, so there is no SQL for the whole; ``tests/llm/test_pipeline.py``
holds the rows of ``run`` against plain Python on a small table.

Defined cases, for every stage: a null or empty text is a document without words (kept by
all stages, once); rows without doc_id stay apart from near-dedup, which keeps them all,
and come first in the token files; rows that repeat an id are rows of their own, and of
rows alike in id and text near-dedup keeps one; null languages and sources are values;
further columns, of any name, pass through; an empty table gives empty results.
"""

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import decontaminate, mixing, simhash, token_binary, toxicity
from voxlake.llm.common import discard, stored
from voxlake.llm.queries import MOST, SHARE, WEIGHTS, table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the schedule's order; the last of a source is cut to the words taken."""
    return mixing.mixed(docs, WEIGHTS, SHARE, MOST)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, in ascending doc_id order as their format has it; a row for each document in them."""
    return token_binary.tokenized(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
        # the stage's result is written (the last writes its files itself): what it read can go
        if before is not None:
            discard(before)
        before = docs
    return docs
