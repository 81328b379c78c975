"""Corpus pipeline: quality rules, near duplicates, mixing, BPE encoding.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame.  ``run`` applies them to the ``documents`` table, each stage on what the one before
has written.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from varkit.llm.bpe import encode_documents
from varkit.llm.common import stored
from varkit.llm.jaccard import one_per_group
from varkit.llm.mixing import mixed_documents
from varkit.llm.quality import quality
from varkit.llm.queries import byte_bpe_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    judged = quality(docs, keep_columns=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group.  Documents
    without words belong to no group and all stay."""
    return one_per_group(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and pass that takes words from it, its text what was taken."""
    return mixed_documents(docs, COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix in ids: counts and digests of the ids and of the decoded text."""
    return encode_documents(docs, byte_bpe_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Components of a similarity graph and BPE can't be said in SQL; the tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
