"""Every query of the engine's own operators by name, and the SQL beside it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES (name to function) and ORACLE (name to SQL).
FAMILIES = ["text_queries", "number_queries", "log_queries", "table_queries", "layout_queries", "markup_queries", "stream_queries", "office_queries", "lookup_queries", "edit_queries", "source_queries"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in FAMILIES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
