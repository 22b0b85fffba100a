"""Customer and segment features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import days_between, ratio, same_flag
from tidemark.operators.prep import top_by

CUSTOMER_COLUMNS = ("customer_id", "session_recency_days", "n_sessions", "n_page_view", "n_add_to_cart", "n_checkout", "n_purchase", "top_viewed_category", "order_recency_days", "n_orders", "total_spend", "avg_order_value", "top_purchased_category")
FUNNEL = ("page_view", "add_to_cart", "checkout", "purchase")


def session_features(sessions: DataFrame, as_of: Column) -> DataFrame:
    """By customer, days since the last session and number of sessions."""
    return sessions.where(F.col("start_time") <= as_of).groupBy("customer_id").agg(days_between(as_of, F.max("start_time")).alias("session_recency_days"), F.count_distinct("session_id").alias("n_sessions"))


def event_counts(events: DataFrame, types: Sequence[str] = FUNNEL) -> DataFrame:
    """By customer, the number of events of each type, 0 where there is none."""
    return events.groupBy(F.col("user_id").alias("customer_id")).agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types])


def category_counts(events: DataFrame, products: DataFrame, event_type: str) -> DataFrame:
    """By customer and category, the events of a type."""
    seen = events.where((F.col("event_type") == event_type) & F.col("product_id").isNotNull()).select(F.col("user_id").alias("customer_id"), "product_id")
    return seen.join(products.select("product_id", "category"), "product_id").where(F.col("category").isNotNull()).groupBy("customer_id", "category").agg(F.count(F.lit(1)).alias("n"))


def top_viewed(events: DataFrame, products: DataFrame) -> DataFrame:
    return top_by(category_counts(events, products, "page_view"), "customer_id", "category", "n", "top_viewed_category")


def order_features(details: DataFrame, as_of: Column) -> DataFrame:
    """By customer, recency, number, spend and mean value of orders, each order counted once."""
    once = details.where(F.col("order_time") <= as_of).select("customer_id", "order_id", "order_time", "total_usd").dropDuplicates(["customer_id", "order_id"])
    return once.groupBy("customer_id").agg(days_between(as_of, F.max("order_time")).alias("order_recency_days"), F.count(F.lit(1)).alias("n_orders"), F.sum("total_usd").alias("total_spend"), F.avg("total_usd").alias("avg_order_value"))


def category_quantities(details: DataFrame) -> DataFrame:
    """By customer and category, the quantity bought."""
    return details.where(F.col("category").isNotNull()).groupBy("customer_id", "category").agg(F.sum("quantity").alias("n"))


def top_purchased(details: DataFrame) -> DataFrame:
    return top_by(category_quantities(details), "customer_id", "category", "n", "top_purchased_category")


def customer_features(customers: DataFrame, sessions: DataFrame, events: DataFrame, products: DataFrame, details: DataFrame, session_as_of: Column, order_as_of: Column) -> DataFrame:
    """The customer table: every customer once; counts and spend are 0 where nothing is known, recencies, means and categories null."""
    before = details.where(F.col("order_time") <= order_as_of)
    out = customers.select("customer_id")
    for part in (session_features(sessions, session_as_of), event_counts(events), top_viewed(events, products), order_features(before, order_as_of), top_purchased(before)):
        out = out.join(part, "customer_id", "left")
    counts = ["n_sessions", "n_orders", *[f"n_{t}" for t in FUNNEL]]
    return out.na.fill(0, counts).na.fill(0.0, ["total_spend"]).select(*CUSTOMER_COLUMNS)


def dominance(counts: DataFrame, name: str, diversity: str) -> DataFrame:
    """By customer, share of the largest category and number of categories with a positive count."""
    return counts.groupBy("customer_id").agg(ratio(F.max("n"), F.sum("n")).alias(name), F.count_if(F.col("n") > 0).alias(diversity))


def segment_features(features: DataFrame, views: DataFrame, quantities: DataFrame) -> DataFrame:
    """Ratios and transforms for clustering on top of the customer table."""
    viewed, bought = dominance(views, "dominant_view_ratio", "view_diversity"), dominance(quantities, "dominant_purchase_ratio", "purchase_diversity")
    joined = features.join(viewed, "customer_id", "left").join(bought, "customer_id", "left")
    return joined.select(
        *features.columns,
        ratio("n_add_to_cart", "n_page_view").alias("cart_per_view"),
        ratio("n_purchase", "n_add_to_cart").alias("purchase_per_cart"),
        ratio("n_page_view", "n_sessions").alias("views_per_session"),
        ratio("n_purchase", "n_page_view").alias("purchase_per_view"),
        F.log1p("total_spend").alias("log_total_spend"),
        F.log1p(F.col("n_page_view").cast("double")).alias("log_page_views"),
        same_flag("top_viewed_category", "top_purchased_category").alias("category_match"),
        "dominant_view_ratio", F.coalesce("view_diversity", F.lit(0)).alias("view_diversity"),
        "dominant_purchase_ratio", F.coalesce("purchase_diversity", F.lit(0)).alias("purchase_diversity"),
    )


def fill_for_clustering(df: DataFrame, zeros: Sequence[str], recencies: Sequence[str]) -> DataFrame:
    """Missing counts and ratios become 0, missing recencies one more than the largest (0 if all are missing)."""
    largest = df.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).alias(f"__max_{c}") for c in recencies])
    out = df.crossJoin(F.broadcast(largest)) if recencies else df  # one row, an aggregate
    fixed = {c: F.coalesce(F.col(c), F.lit(0)) for c in zeros} | {c: F.coalesce(F.col(c), F.col(f"__max_{c}")) for c in recencies}
    return out.select(*[fixed.get(c, F.col(c)).alias(c) for c in df.columns])


def windowed(details: DataFrame, events: DataFrame, order_as_of: Column, event_as_of: Column, days: Sequence[int] = (30, 90, 365)) -> DataFrame:
    """By customer, orders, spend and active events in trailing windows [as of - d, as of); all windows in one pass of each input."""
    once = details.select("customer_id", "order_id", "order_time", "total_usd").dropDuplicates(["customer_id", "order_id"])

    def inside(ts: str, as_of: Column, d: int) -> Column:
        return (F.col(ts) >= as_of - F.expr(f"INTERVAL {d} DAYS")) & (F.col(ts) < as_of)

    sums = []
    for d in days:
        within = inside("order_time", order_as_of, d)
        sums += [F.count_if(within).alias(f"orders_{d}d"), F.coalesce(F.sum(F.when(within, F.col("total_usd"))), F.lit(0.0)).alias(f"spend_{d}d")]
    spent = once.where(inside("order_time", order_as_of, max(days))).groupBy("customer_id").agg(*sums)
    counts = [F.count_if(inside("timestamp", event_as_of, d)).alias(f"events_{d}d") for d in days]
    active = events.where(inside("timestamp", event_as_of, max(days))).groupBy(F.col("user_id").alias("customer_id")).agg(*counts)
    joined = spent.join(active, "customer_id", "full")
    return joined.select("customer_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in joined.columns if c != "customer_id"])


def active_share(customers: DataFrame, windows: DataFrame, days: Sequence[int] = (30, 90, 365)) -> DataFrame:
    """By window, the percentage of all customers with an order in it, and of those with an event."""
    every = customers.select("customer_id").join(windows, "customer_id", "left")
    share = lambda c: 100 * F.avg(F.coalesce((F.col(c) > 0).cast("double"), F.lit(0.0)))
    row = every.agg(*[share(f"{kind}_{d}d").alias(f"{kind}_{d}") for d in days for kind in ("orders", "events")])
    rows = F.array(*[F.struct(F.lit(d).cast("long").alias("days"), F.col(f"orders_{d}").alias("ordering_pct"), F.col(f"events_{d}").alias("active_pct")) for d in days])
    return row.select(F.explode(rows).alias("x")).select("x.*")


def segmentation_match(first: DataFrame, second: DataFrame, key: str = "customer_id", segment: str = "segment") -> DataFrame:
    """Customers that two segmentations share, and the share of those whose segment is the same in both."""
    both = first.select(key, F.col(segment).alias("__a")).join(second.select(key, F.col(segment).alias("__b")), key)
    return both.agg(F.count(F.lit(1)).alias("customers"), F.avg(F.coalesce((F.col("__a") == F.col("__b")).cast("double"), F.lit(0.0))).alias("match_rate"))


def bought_or_not(features: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean, median and deviation of measures, for customers with and without an order."""
    return features.groupBy((F.col("n_orders") > 0).alias("buyer")).agg(F.count(F.lit(1)).alias("n"), *[x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"), F.stddev_samp(m).alias(f"{m}_std"))])


def clip_at_quantile(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """The column limited to its exact quantile."""
    limit = df.agg(F.percentile(column, F.lit(q)).alias("__limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(column, F.least(F.col(column).cast("double"), F.col("__limit"))).drop("__limit")


def rank_features(df: DataFrame, group: str, value: str) -> DataFrame:
    """Every row with the size of its group."""
    return df.withColumn("group_size", F.count(value).over(Window.partitionBy(group)))
