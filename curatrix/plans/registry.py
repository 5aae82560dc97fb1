"""Registered queries: a Spark callable each, and the SQL that states the expected rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from curatrix import constants as K
from curatrix.plans import derived

Tables = Callable[[str], DataFrame]

_SPARK: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("url_queries", "text_queries", "extract_queries", "task_queries", "rank_queries")

# Character classes for the oracle's regex engine.
WS, WORD, NOT_WORD, LINE, TOKEN = K.WS, K.WORD, K.NOT_WORD_NOR_WS, K.LINE_BREAK, K.TOKEN


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function of the tables under its own name. ``uses`` names derived tables the
    SQL reads; they are put before it."""

    def register(build: Callable[[Tables], DataFrame]):
        _SPARK[build.__name__] = build
        if sql is not None:
            text = sql.strip()
            if uses:
                text = _after(derived.oracle_ctes(*uses), text)
            _SQL[build.__name__] = text
        return build

    return register


def _after(head: str, text: str) -> str:
    """One WITH clause out of the derived tables' and the query's own."""
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]},\n{text[15:]}"
    return f"{head},\n{text[5:]}" if text.startswith("WITH ") else f"{head}\n{text}"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"curatrix.plans.{module}")


@dataclass(frozen=True)
class _Run:
    build: Callable[[Tables], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(partial(derived.table, spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _Run(build) for name, build in _SPARK.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
