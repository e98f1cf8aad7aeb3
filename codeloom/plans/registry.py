"""All queries over the reference's operators, and the SQL they are compared with.

Each module of `MODULES` has a dict QUERIES (name to function of session and folder) and a dict ORACLE
(name to SQL over the tables of that folder).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("retrieval", "graphs", "ledgers", "texts", "records")
FLAGSHIP = "bm25_ranking"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLE.items()}
