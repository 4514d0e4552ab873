"""The registered queries over the given tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.functions import html_markdown, markup
from granary.operators import chunks, contracts, evaluation, evidence, history, operations, reports, retrieval, staging, structured, trace

FLAGSHIP = "bm25_topk"
_ALL = chunks.QUERIES | retrieval.QUERIES | evaluation.QUERIES | operations.QUERIES | structured.QUERIES | evidence.QUERIES | trace.QUERIES | contracts.QUERIES | reports.QUERIES | staging.QUERIES | history.QUERIES | markup.QUERIES | html_markdown.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
