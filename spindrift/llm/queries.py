"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_ngram_jaccard_join": "jaccard",
    "op2_rendezvous_sharding": "sharding",
    "op3_warc_index_merge": "warc",
    "op4_quality_rules": "quality",
    "op5_sentencepiece_suffix_array": "sentencepiece",
    "op6_token_counts": "tokencount",
    "op7_line_dedup_winnowing": "linededup",
    "op8_url_filters": "urlfilter",
    "op9_html_suffix_array": "htmltext",
    "op10_decontamination_qgram_bands": "decontaminate",
    "op11_nearest_neighbours": "neighbours",
    "op12_filter_interaction_audit": "filteraudit",
    "op13_embedding_whitening": "whitening",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"spindrift.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from spindrift.llm.filteraudit import OP12_SQL
    from spindrift.llm.urlfilter import OP8_SQL
    from spindrift.llm.warc import OP3_SQL

    return {"op3_warc_index_merge": OP3_SQL, "op8_url_filters": OP8_SQL, "op12_filter_interaction_audit": OP12_SQL}
