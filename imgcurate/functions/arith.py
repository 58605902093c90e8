"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column | str, by: int) -> Column:
    """Quotient rounded down, exact for all BIGINT values."""
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    return F.call_function("div", v - F.pmod(v, F.lit(by)), F.lit(by))
