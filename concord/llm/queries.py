"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to function of session and folder) and ORACLES (name to DuckDB SQL).
MODULES = ["query_packing", "query_bitsliced", "query_langid", "query_simhash", "query_warc", "query_chat", "query_decontaminate", "query_tokencount", "query_extract", "query_quality", "query_hardnegatives", "query_vectorcodes", "query_exactdedup"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"concord.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"concord.llm.{m}").ORACLES.items()}
