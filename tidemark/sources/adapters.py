"""The retail star schema (customers, products, sessions, events, orders, order items) over the given tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_GAP_SECONDS = 24 * 3600
#: Event types of the stream by the name they have in the star schema; others keep theirs.
EVENT_TYPES = {"view": "page_view", "click": "add_to_cart", "signup": "checkout", "purchase": "purchase"}


def sessionize(events: DataFrame, user_col: str, ts_col: str, gap_seconds: int) -> DataFrame:
    """Adds ``session_no``: 1, 2, ... by user; a session ends where the next event comes more than the gap later."""
    order = Window.partitionBy(user_col).orderBy(ts_col, "event_id")
    before = F.lag(ts_col).over(order)
    starts = F.when(before.isNull() | (F.col(ts_col) > before + F.expr(f"INTERVAL {gap_seconds} SECONDS")), 1).otherwise(0)
    return events.withColumn("__starts", starts).withColumn("session_no", F.sum("__starts").over(order).cast("long")).drop("__starts")


@dataclass(frozen=True)
class Retail:
    """Lazy views over the tables below a folder."""

    spark: SparkSession
    path: str
    kept: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """A table that a query reads several times, computed once; the first under a name is kept."""
        return self.kept.setdefault(name, df.persist())

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("price_usd"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_time"), F.col("o_totalprice").alias("total_usd"))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").alias("line_total_usd"))

    @cached_property
    def events(self) -> DataFrame:
        kind = F.col("event_type")
        for raw, name in EVENT_TYPES.items():
            kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
        typed = self.raw("events").select("event_id", "user_id", F.col("ts").alias("timestamp"), kind.alias("event_type"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
        on_product, cart = F.col("event_type").isin("page_view", "add_to_cart"), F.col("event_type") == "add_to_cart"
        numbered = sessionize(typed, "user_id", "timestamp", SESSION_GAP_SECONDS)
        return numbered.select("event_id", (F.col("user_id") * 100000 + F.col("session_no")).alias("session_id"), "user_id", "timestamp", "event_type", F.when(on_product, F.col("k")).alias("product_id"), F.when(cart, 1 + F.col("event_id") % 3).cast("long").alias("qty"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount_usd"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.events.groupBy("session_id").agg(F.min("user_id").alias("customer_id"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count(F.lit(1)).alias("n_events"))


#: The same views in SQL, to be put before a query's own text.
ADAPTER_SQL = """
WITH customers AS (
  SELECT c_custkey AS customer_id, c_name AS name, n_name AS country, c_acctbal AS balance, c_mktsegment AS segment
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
), products AS (
  SELECT p_partkey AS product_id, p_type AS category, p_name AS product_name, p_retailprice AS price_usd FROM part
), sales AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_time, o_totalprice AS total_usd FROM orders
), order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS line_total_usd FROM lineitem
), marked AS (
  SELECT event_id, user_id, ts AS timestamp,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'checkout' ELSE event_type END AS event_type,
    value, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
    CASE WHEN lag(ts) OVER u IS NULL OR ts > lag(ts) OVER u + INTERVAL 1 DAY THEN 1 ELSE 0 END AS starts
  FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
), clicks AS (
  SELECT event_id, user_id * 100000 + CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id,
    user_id, timestamp, event_type,
    CASE WHEN event_type IN ('page_view', 'add_to_cart') THEN k END AS product_id,
    CASE WHEN event_type = 'add_to_cart' THEN 1 + event_id % 3 END AS qty,
    CASE WHEN event_type = 'purchase' THEN value END AS amount_usd
  FROM marked
), sessions AS (
  SELECT session_id, min(user_id) AS customer_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS n_events FROM clicks GROUP BY session_id
)
"""
