"""Data behind the usual figures, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the column's range; the last holds its right edge."""
    known = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = known.crossJoin(F.broadcast(ends)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("w") == 0, 1).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")) + 1, F.lit(bins)))
    return wide.groupBy(at.cast("long").alias("bin")).agg(F.min("lo").alias("lo"), F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("lo") + F.col("bin") * F.col("w")).alias("high"), "n")


def quantile_points(df: DataFrame, column: str, points: int = 20) -> DataFrame:
    """(p, value) at evenly spread probabilities, for a quantile plot."""
    ps = [(i + 0.5) / points for i in range(points)]
    row = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in ps])).alias("q"))
    return row.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), "q")).alias("x")).select(F.col("x.p").alias("p"), F.col("x.q").alias("value"))


def residual_points(df: DataFrame, truth: str, predicted: str, bins: int = 20) -> DataFrame:
    """Mean and spread of residuals by bin of the prediction."""
    edges = df.agg(F.min(predicted).alias("lo"), F.max(predicted).alias("hi"))
    at = F.least(F.floor((F.col(predicted) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(edges)).groupBy(at.cast("long").alias("bin")).agg(F.avg(F.col(truth) - F.col(predicted)).alias("mean"), F.stddev_pop(F.col(truth) - F.col(predicted)).alias("std"), F.count(F.lit(1)).alias("n"))
