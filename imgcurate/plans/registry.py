"""Registered queries: each an operator over the given tables, with SQL to check it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def half_even(value: str, places: int) -> str:
    """SQL for a DECIMAL rounded to the even neighbour at ties, as DOUBLE."""
    x = f"(CAST({value} AS DECIMAL(28,12)) * {10**places})"
    return (
        f"(CASE WHEN {x} - floor({x}) < 0.5 THEN floor({x}) WHEN {x} - floor({x}) > 0.5 THEN floor({x}) + 1 "
        f"ELSE floor({x}) + CAST(floor({x}) AS BIGINT) % 2 END)::DOUBLE / {10**places}"
    )
