"""Segment profiles, quality measures, model metrics and data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.functions.text import half_away


def shares(df: DataFrame, group: str) -> DataFrame:
    """Count and share of each known group."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(group, "n", ratio("n", "total").alias("share"))


def entropy(parts: DataFrame, share: str = "share", top: int = 1) -> DataFrame:
    """Entropy in bits, over its maximum (null for one group or none), and concentration in the largest groups."""
    ranked = parts.where(F.col(share) > 0).withColumn("__at", F.row_number().over(Window.orderBy(F.desc(share))))  # one row a group: small by nature
    return ranked.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(-F.sum(F.col(share) * F.log2(share)), F.lit(0.0)).alias("entropy"), F.sum(F.when(F.col("__at") <= top, F.col(share))).alias("concentration")).withColumn("normalised", F.when(F.col("groups") > 1, F.col("entropy") / F.log2(F.col("groups").cast("double"))))


def quality_single(assigned: DataFrame, segment: str, total: int | None = None) -> DataFrame:
    """Quality row of one label a customer: ratios over customers."""
    return entropy(shares(assigned, segment)).select(F.lit("single").alias("kind"), "groups", "entropy", "normalised", "concentration")


def quality_multi(labels: DataFrame, labels_col: str, status_col: str) -> DataFrame:
    """Quality row of several labels a customer: ratios over all labels of rows whose status is ok."""
    picked = labels.where(F.col(status_col) == "ok").select(F.explode(labels_col).alias("label"))
    return entropy(shares(picked, "label")).select(F.lit("multi").alias("kind"), "groups", "entropy", "normalised", "concentration")


def top_category_text(df: DataFrame, group: str, category: str, k: int = 3) -> DataFrame:
    """By group, its largest categories with their shares in words; ties go to the smaller name."""
    counts = df.where(F.col(group).isNotNull() & F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group)
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(by), "at": F.row_number().over(by.orderBy(F.desc("n"), F.asc(category)))}).where(F.col("at") <= k)
    parts = F.array_sort(F.collect_list(F.struct("at", F.concat(F.col(category), F.lit(": "), F.format_string("%.1f", half_away(F.col("share") * 100, 1)), F.lit("%")).alias("text"))))
    return ranked.groupBy(group).agg(F.array_join(parts.getField("text"), "; ").alias("top_categories"))


def profile(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """By segment, its size and share, and mean and median of measures."""
    total = df.where(F.col(group).isNotNull()).agg(F.count(F.lit(1)).alias("__total"))
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("customers"), *[x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"))])
    return rows.crossJoin(F.broadcast(total)).withColumn("share", ratio("customers", "__total")).drop("__total")


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """R2, RMSE, MAE and MAPE in one pass."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    return df.agg((1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.try_divide(F.abs(e), F.abs(y))).alias("mape"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, macro and weighted F1 of hard predictions."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("guess"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("guess"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    by = sides.groupBy("c").agg(F.sum("truth").alias("truth"), F.sum("guess").alias("guess"), F.sum("hit").alias("hit"))
    f1 = ratio(2 * F.col("hit"), F.col("truth") + F.col("guess"))
    return by.agg(ratio(F.sum("hit"), F.sum("truth")).alias("accuracy"), F.avg(f1).alias("macro_f1"), ratio(F.sum(f1 * F.col("truth")), F.sum("truth")).alias("weighted_f1"))


def auc(df: DataFrame, truth: str, score: str, ranges: int = 64) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half.

    Counts by score are dealt into ranges between approximate quantiles; running sums go over one range
    at a time, and over the ranges' totals.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    cuts = by.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 1000).alias("cuts"))
    dealt = by.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = dealt.groupBy("part").agg(F.sum("neg").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    below = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    under = F.col("base") + F.col("inner")
    rows = dealt.withColumn("inner", F.coalesce(F.sum("neg").over(below), F.lit(0))).join(F.broadcast(base), "part")
    return rows.agg(ratio(F.sum(F.col("pos") * (under + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def residual_summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean, population deviation, range, and bias-corrected skewness and excess kurtosis of residuals."""
    e = F.col(truth) - F.col(predicted)
    m = df.select(e.alias("e")).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.min("e").alias("min"), F.max("e").alias("max"), F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2"))
    n = F.col("n").cast("double")
    return m.select("mean", "std", "min", "max", F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column, rows, nulls, distinct values, mean, deviation, range and quartiles."""
    stats = [("nulls", lambda c: F.sum(F.col(c).isNull().cast("long"))), ("distinct", F.count_distinct), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("q25", lambda c: F.percentile(c, F.lit(0.25))), ("median", F.median), ("q75", lambda c: F.percentile(c, F.lit(0.75))), ("max", F.max)]
    row = df.agg(*[f(c).cast("double").alias(f"{c}__{name}") for c in columns for name, f in stats])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{name}").alias(name) for name, _ in stats]) for c in columns])).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def correlation_norm(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Frobenius norm of the strict upper triangle of the columns' correlation matrix; the matrix comes from one distributed pass of products."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    ready = vectors.where(F.col(vector_col).isNotNull()).select(array_to_vector(F.col(vector_col)).alias("v"))
    matrix = Correlation.corr(ready, "v").first()[0].toArray()
    upper = matrix[np.triu_indices(len(matrix), 1)]
    return vectors.sparkSession.createDataFrame([(float(np.sqrt(np.nansum(upper * upper))),)], "norm double")


class IntegrityError(ValueError):
    """A table breaks one of its rules."""


def require_clean(df: DataFrame, rules: dict[str, str], key: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Raise where a rule (an SQL condition of bad rows), the key or the number of rows is broken; one aggregate row."""
    found = df.agg(F.count(F.lit(1)).alias("__rows"), *([F.count_distinct(*key).alias("__keys")] if key else []), *[F.count_if(F.expr(c)).alias(name) for name, c in rules.items()]).first().asDict()
    bad = [f"{name}: {found[name]}" for name in rules if found[name]]
    if key and found["__keys"] != found["__rows"]:
        bad.append(f"{found['__rows'] - found['__keys']} rows repeat ({', '.join(key)})")
    if rows is not None and found["__rows"] != rows:
        bad.append(f"{found['__rows']} rows instead of {rows}")
    if bad:
        raise IntegrityError("; ".join(bad))
    return df


def rule_counts(df: DataFrame, rules: dict[str, str], key: Sequence[str] = ()) -> DataFrame:
    """(rule, broken): rows that break each rule, and rows that repeat the key; what :func:`require_clean` raises on."""
    columns = [F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(rules.values())]
    names = [*rules, *(["repeated key"] if key else [])]
    if key:
        columns.append((F.count(F.lit(1)) - F.count_distinct(*key)).alias(f"c{len(rules)}"))
    return df.agg(*columns).select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("broken")) for i, n in enumerate(names)])).alias("x")).select("x.*")


CUSTOMER_RULES = {"negative count": "n_sessions < 0 OR n_orders < 0 OR n_page_view < 0", "negative spend": "total_spend < 0", "negative recency": "order_recency_days < 0 OR session_recency_days < 0"}
SEGMENT_RULES = {"ratio out of range": "dominant_view_ratio NOT BETWEEN 0 AND 1 OR dominant_purchase_ratio NOT BETWEEN 0 AND 1", "not finite": "isnan(log_total_spend) OR abs(log_total_spend) = double('infinity')"}


def check_assignment(assigned: DataFrame, k: int, rows: int) -> DataFrame:
    """Every customer once, with a segment from 0 to k - 1."""
    return require_clean(assigned, {"segment out of range": f"segment_id IS NULL OR segment_id < 0 OR segment_id >= {k}"}, ("customer_id",), rows)
