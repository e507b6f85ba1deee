"""The corpus pipeline: stages that each read the documents their predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Verdicts
are on rows, not on ids: where doc_ids are null or repeated, stages tell rows apart by numbers of their own. Of a group of
copies one row stays, that with the smallest doc_id; a row with a null doc_id only if no row of the group has an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import row_keyed, table
from terrace.llm.fingerprints import exact_groups
from terrace.llm.jaccard import near_duplicates
from terrace.llm.mixing import repeated
from terrace.llm.pieces import digests
from terrace.llm.toxicity import learned, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return without_toxic(docs, learned(docs, table(spark, sf_dir, "labels")))


def _firsts(docs: DataFrame, grouped: Callable[[DataFrame, str], DataFrame], group: str) -> DataFrame:
    """Of each group of rows the one with the smallest doc_id. grouped gives each key its group, named by the smallest key."""
    keyed, row = row_keyed(docs)
    groups = grouped(keyed, row)
    if row == "doc_id":
        first = groups.filter(F.col(row) == F.col(group)).select(F.col(row).alias("kept_row"))
    else:
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row]
        first = groups.select(row, group).join(keyed.select(row, "doc_id"), row).groupBy(group).agg(least.alias("kept_row"))
    return keyed.join(first.select("kept_row"), F.col(row) == F.col("kept_row"), "left_semi").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    return _firsts(docs, lambda rows, key: exact_groups(rows, key=key), "keep_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, a similarity of 0.8."""
    return _firsts(docs, lambda rows, key: near_duplicates(rows, key=key, n=5, percent=80), "component_id")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left, and digests of their ids and of what they decode to."""
    return digests(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: SQL has no pattern grammar and no pieces; the pipeline is tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
