"""Relational preparation: star joins, carts, scored event mart, baskets, time splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import constant_map

#: Score of an event by its type.
EVENT_SCORES = {"page_view": 1, "add_to_cart": 3, "checkout": 4, "purchase": 5}
CART_EVENTS = ("checkout", "purchase")


def session_events(sessions: DataFrame, events: DataFrame, products: DataFrame) -> DataFrame:
    """Events with their session and, where they have a product, its category."""
    own = events.select("session_id", "event_type", "product_id")
    return sessions.select("session_id", "customer_id", "start_time").join(own, "session_id").join(products.select("product_id", "category"), "product_id", "left").select("session_id", "customer_id", "start_time", "event_type", "product_id", "category")


def order_details(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with their lines and categories; an order without lines stays, with nulls."""
    return orders.join(items.select("order_id", "product_id", "quantity"), "order_id", "left").join(products.select("product_id", "category"), "product_id", "left").select("order_id", "customer_id", "order_time", "total_usd", "product_id", "quantity", "category")


def restore_carts(events: DataFrame) -> DataFrame:
    """Checkout and purchase events, once for each product in their session's cart, with its summed quantity.

    All carts of the session count, also later ones; events of sessions without a cart go.
    """
    carts = events.where((F.col("event_type") == "add_to_cart") & F.col("product_id").isNotNull()).groupBy("session_id", "product_id").agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))
    ends = events.where(F.col("event_type").isin(*CART_EVENTS)).select("event_id", "session_id", "timestamp", "event_type")
    return ends.join(carts, "session_id").select("event_id", "session_id", "timestamp", "event_type", "product_id", "qty")


def score_mart(events: DataFrame, sessions: DataFrame, scores: Mapping[str, float] = EVENT_SCORES) -> DataFrame:
    """Scored user-item events: those on a product as they are, checkouts and purchases with restored carts; unknown types score null."""
    direct = events.where(~F.col("event_type").isin(*CART_EVENTS) & F.col("product_id").isNotNull()).select("event_id", "session_id", "timestamp", "event_type", "product_id")
    full = direct.unionByName(restore_carts(events).drop("qty"))
    users = sessions.select("session_id", F.col("customer_id").alias("user_id"))
    return full.join(users, "session_id", "left").select("user_id", F.col("product_id").alias("item_id"), "timestamp", constant_map(F.col("event_type"), scores).cast("long").alias("score"), "event_type")


def unmapped_types(events: DataFrame, scores: Mapping[str, float] = EVENT_SCORES) -> DataFrame:
    """Event types without a score, with their counts."""
    return events.where(~F.col("event_type").isin(*scores)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def basket(items: DataFrame, orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Basket lines in the layout of the basket files, without lines that lack a field."""
    joined = items.join(orders, "order_id", "left").join(products, "product_id", "left").join(customers.select("customer_id", "country"), "customer_id", "left")
    return joined.select(F.col("order_id").cast("int").alias("BillNo"), F.col("product_name").alias("Itemname"), F.col("quantity").cast("int").alias("Quantity"), F.date_format("order_time", "yyyy-MM-dd").alias("Date"), F.format_string("%.2f", "price_usd").alias("Price"), F.col("customer_id").cast("int").alias("CustomerID"), F.col("country").alias("Country")).na.drop("any")


def split_by_time(df: DataFrame, ts_col: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and rows at it or later."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return df.where(F.col(ts_col) < at), df.where(F.col(ts_col) >= at)


def user_item_scores(mart: DataFrame) -> DataFrame:
    """Summed score by user and item; events without a score add nothing."""
    return mart.groupBy("user_id", "item_id").agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score"))


def heavy_cold(mart: DataFrame, threshold: int = 10) -> DataFrame:
    """Users with their number of events and whether they are heavy (at least the threshold) or cold."""
    return mart.groupBy("user_id").agg(F.count("item_id").alias("n_events")).withColumn("user_type", F.when(F.col("n_events") >= threshold, "heavy").otherwise("cold"))


def new_in_test(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """By key, the distinct values of the test rows that no training row has."""
    return {k: test.select(k).distinct().join(train.select(k).distinct(), k, "left_anti") for k in keys}


def interaction_pairs(purchases: DataFrame, events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """Distinct (user_id, item_id) of purchases and of events of the given types."""
    clicks = events.where(F.col("event_type").isin(*event_types) & F.col("product_id").isNotNull()).select("user_id", F.col("product_id").alias("item_id"))
    return purchases.select("user_id", "item_id").unionByName(clicks).distinct()


def carts_after_checkout(events: DataFrame) -> DataFrame:
    """Pairs of a checkout and a cart event of the same session that comes later, by session."""
    cart = events.where(F.col("event_type") == "add_to_cart").select("session_id", F.col("timestamp").alias("cart_at"))
    out = events.where(F.col("event_type") == "checkout").select("session_id", F.col("timestamp").alias("out_at"))
    return cart.join(out, "session_id").where("cart_at > out_at").groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"))


def cart_reconciliation(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of sessions whose summed cart quantity equals the expected size (session_id, cart_size)."""
    carts = events.where(F.col("event_type") == "add_to_cart").groupBy("session_id").agg(F.sum("qty").alias("qty"))
    return expected.join(carts, "session_id", "left").agg(F.count(F.lit(1)).alias("sessions"), F.avg(F.coalesce((F.col("qty") == F.col("cart_size")).cast("double"), F.lit(0.0))).alias("match_rate"))


def top_by(df: DataFrame, group: str, value: str, measure: str, name: str) -> DataFrame:
    """By group, the value with the largest measure; ties go to the smaller value."""
    first = Window.partitionBy(group).orderBy(F.desc(measure), F.asc(value))
    return df.withColumn("__at", F.row_number().over(first)).where("__at = 1").select(group, F.col(value).alias(name))
