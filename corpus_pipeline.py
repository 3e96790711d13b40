"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and rereads it as
the next stage's documents. All stages but the last return the columns of ``documents``, whatever further columns it has. An empty
table gives an empty table; texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import bpe, decontaminate, near_copies, quality, secrets
from logloom.llm.common import documents, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and white-space texts have no words and are rejected; every row is judged alone, so repeated rows stay or go together.
    """
    return quality.passing(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Near copies are texts with SimHash fingerprints (five-word shingles) 4 bits apart at most, or with a Jaccard similarity of 0.8 or more
    on these shingles. Null, empty and white-space texts are one group. Of a tie (repeated doc_ids, repeated rows) one row stays, a null
    doc_id only where the group has no other.
    """
    return near_copies.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts, and items without words, have no window."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every row stays, repeated rows too. A null text stays null; n_chars follows the text."""
    return secrets.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row for each. A null text is the empty text, which has no tokens."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("bpe encoding and decoding", bpe_stage),
]
#: The fingerprints, the tokenizer and the ownership scan have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
