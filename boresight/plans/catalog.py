"""Queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boresight.plans import backtests, records, reports, sequences, spatial, texts, tracks, training

PARTS = (spatial, sequences, texts, records, reports, tracks, training, backtests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for part in PARTS for n, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for part in PARTS for n, q in part.ORACLES.items()}
