"""The operators' queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm.chat_format import OP9_SQL, op9_chat_format
from tallyhouse.llm.collocations import OP13_SQL, op13_collocations
from tallyhouse.llm.embedding_dedup import OP12_SQL, op12_embedding_dedup
from tallyhouse.llm.fill_middle import OP11_SQL, op11_fill_middle
from tallyhouse.llm.html_text import op7_html_text
from tallyhouse.llm.language_id import op1_language_id
from tallyhouse.llm.mixing import OP4_SQL, op4_mixing
from tallyhouse.llm.near_dedup import op8_near_dedup
from tallyhouse.llm.packing import op5_packing
from tallyhouse.llm.quality_rules import op6_quality_rules
from tallyhouse.llm.token_files import op10_token_files
from tallyhouse.llm.toxicity import op3_toxicity
from tallyhouse.llm.vector_search import op2_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_vector_search, op3_toxicity, op4_mixing, op5_packing, op6_quality_rules, op7_html_text, op8_near_dedup, op9_chat_format, op10_token_files,
        op11_fill_middle, op12_embedding_dedup, op13_collocations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op9_chat_format": OP9_SQL, "op11_fill_middle": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
