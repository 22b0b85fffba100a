"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.adapters import ADAPTER_SQL, Retail

ORDER_SPLIT, EVENT_SPLIT = "2000-07-01", "2024-01-24"
ORDER_AS_OF, EVENT_AS_OF = "2001-08-02", "2024-01-31"
PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plan(sql: str | None = None, views: bool = True, recursive: bool = False):
    """Register a function of the retail views under its name; ``sql`` follows the views' definitions, and may refer to itself if ``recursive``."""
    head = ADAPTER_SQL.rstrip().replace("WITH", "WITH RECURSIVE", 1) if recursive else ADAPTER_SQL.rstrip()

    def add(f: Callable[[Retail], DataFrame]):
        text = None if sql is None else f"{head}{sql}" if views else sql
        PLANS[f.__name__] = (lambda spark, path, f=f: f(Retail(spark, path)), text)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
