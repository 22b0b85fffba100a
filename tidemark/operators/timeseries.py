"""Time-series features without leakage, and drift between samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import cyclic, weekday


def lag_features(df: DataFrame, ts: str, value: str, lags: Sequence[int] = (1, 7, 14, 30), by: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(ts)
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(order) for k in lags})


def rolling_features(df: DataFrame, ts: str, value: str, windows: Sequence[int] = (7, 14, 30, 90), by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and maximum of the w rows before each; null until w values are known."""
    out = {}
    for w in windows:
        past = Window.partitionBy(*by).orderBy(ts).rowsBetween(-w, -1)
        full = F.count(value).over(past) == w
        out |= {f"{value}_roll_{w}_{name}": F.when(full, f(value).over(past)) for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))}
    return df.withColumns(out)


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Cyclic day of the week and month, and a weekend flag."""
    day, month = weekday(ts), F.month(ts)
    (day_sin, day_cos), (month_sin, month_cos) = cyclic(day, 7), cyclic(month, 12)
    return df.withColumns({"dow_sin": day_sin, "dow_cos": day_cos, "month_sin": month_sin, "month_cos": month_cos, "is_weekend": (day >= 5).cast("long")})


def _stacked(df: DataFrame, columns: Sequence[str], side: int) -> DataFrame:
    """(feature, v, side) of the columns' values that are not null."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.feature", "x.v", F.lit(side).alias("side")).where("v IS NOT NULL")


def psi_by_feature(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(feature, psi): population stability index of each column over equal-width bins of the joint range; the last bin holds its right edge, empty bins count as the floor.

    All columns share two passes: one for the ranges, one for the counts.
    """
    both = _stacked(expected, columns, 0).unionByName(_stacked(actual, columns, 1))
    edges = both.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / width) + 1, F.lit(bins)))
    binned = both.join(F.broadcast(edges), "feature").withColumn("bin", bin_)  # a row a column
    counts = binned.groupBy("feature", "bin").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    filled = every.join(counts, ["feature", "bin"], "left").na.fill(0)
    own = Window.partitionBy("feature")
    p = F.when(F.col("e") == 0, floor).otherwise(F.col("e") / F.sum("e").over(own))
    q = F.when(F.col("a") == 0, floor).otherwise(F.col("a") / F.sum("a").over(own))
    return filled.select("feature", p.alias("p"), q.alias("q")).groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """The population stability index of one column."""
    return psi_by_feature(expected, actual, [column], bins, floor).select("psi")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, over rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    row = df.agg(*[F.corr(both(a, b, a), both(a, b, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def drift_report(expected: DataFrame, actual: DataFrame, columns: Sequence[str], limit: float = 0.2) -> DataFrame:
    """PSI of each column with a flag above the limit."""
    return psi_by_feature(expected, actual, columns).select("feature", "psi", (F.col("psi") > limit).alias("drifted"))


def redundant_pairs(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > limit)
