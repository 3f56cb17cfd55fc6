"""Registered queries: one per operator of SURVEY §2, each with its SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the Spark form over the whole
given tables (through the fixture views); ``SQL[name]`` is the same result as
one DuckDB-runnable statement over the same tables. Column names are aliased
identically on both sides; floating values are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional SQL twin."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from . import (  # noqa: F401
        q_diffs,
        q_graph,
        q_history,
        q_hunks,
        q_js,
        q_reverts,
        q_sources,
        q_streams,
        q_text,
        q_vectors,
    )
