"""All queries of the library, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES: list[str] = ["plans.schedules", "plans.discovery", "plans.takeoff", "plans.graph", "plans.transcripts", "plans.service", "plans.drawings", "plans.manuals_book", "plans.tables_book", "plans.building", "plans.package", "plans.knowledge", "plans.streams", "plans.shards", "plans.sections_book", "plans.agent_book", "plans.report_book"]


def _loaded():
    from importlib import import_module

    return [import_module(f"plumbline.{m}") for m in _MODULES]


def queries() -> dict[str, Query]:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _loaded() for k, q in m.ORACLE_SQL.items()}
