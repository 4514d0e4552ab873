"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm.context_mixing import op4_context_mixing
from granary.llm.decontaminate import op5_decontaminate
from granary.llm.html_extract import op1_html_extract
from granary.llm.importance_resampling import OP13_SQL, op13_importance_resampling
from granary.llm.language_id import op10_language_id
from granary.llm.merkle import OP11_SQL, op11_merkle_fingerprints
from granary.llm.near_duplicates import OP3_SQL, op3_near_duplicates
from granary.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from granary.llm.quality import op8_quality
from granary.llm.quote_links import OP6_SQL, op6_quote_links
from granary.llm.sentencepiece_bpe import op9_sentencepiece_bpe
from granary.llm.url_filter import OP7_SQL, op7_url_filter
from granary.llm.vector_search import op2_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extract,
        op2_vector_search,
        op3_near_duplicates,
        op4_context_mixing,
        op5_decontaminate,
        op6_quote_links,
        op7_url_filter,
        op8_quality,
        op9_sentencepiece_bpe,
        op10_language_id,
        op11_merkle_fingerprints,
        op12_prefix_trie,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": OP3_SQL,
        "op6_quote_links": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op11_merkle_fingerprints": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
