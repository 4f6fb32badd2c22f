"""All queries over the content-addressed model, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.queries import control, dedup, lifecycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (dedup, lifecycle, control):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
