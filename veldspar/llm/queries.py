"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import parts
from veldspar.llm.katz import op10_katz
from veldspar.llm.line_dedup import op4_line_dedup
from veldspar.llm.mixing import OP8_SQL, op8_mixing
from veldspar.llm.packing import op2_packing
from veldspar.llm.quality_classifier import op1_quality_classifier
from veldspar.llm.quality_rules import op9_quality_rules
from veldspar.llm.simhash import op3_simhash
from veldspar.llm.toxicity import op6_toxicity
from veldspar.llm.url_filter import op5_url_filter
from veldspar.llm.vector_search import op7_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_packing, op3_simhash, op4_line_dedup, op5_url_filter,
        op6_toxicity, op7_vector_search, op8_mixing, op9_quality_rules, op10_katz,
    )
} | parts.QUERIES
SQL = {"op8_mixing": OP8_SQL} | parts.SQL
