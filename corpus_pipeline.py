"""A corpus pipeline of five of the llm operators: documents in, packed documents out.

Each stage's result is written to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm.common import drop, store, table
from veldspar.llm.line_dedup import without_repeats
from veldspar.llm.mixing import blend
from veldspar.llm.packing import pack
from veldspar.llm.quality_rules import keep_good
from veldspar.llm.simhash import keep_first


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of similar lines go from the texts; n_chars follows."""
    return without_repeats(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return blend(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, size, bin, offset; uses of one document never share a bin."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("packing", packing)]

#: The quality rules and the packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
