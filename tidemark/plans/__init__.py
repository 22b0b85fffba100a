"""Named queries over the retail views, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import features, graphs, models, prep, quality, recommend, texts
from tidemark.plans.base import PLANS

__all__ = ["features", "graphs", "models", "oracle_sql", "prep", "quality", "queries", "recommend", "texts"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
