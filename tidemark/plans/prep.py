"""Relational preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import r, right_bin, weekday, width_bin
from tidemark.operators import prep
from tidemark.plans.base import EVENT_SPLIT, ORDER_SPLIT, moment, plan, rounded

SESSION_EVENTS = """, session_events AS (
  SELECT s.session_id, s.customer_id, s.start_time, e.event_type, e.product_id, p.category
  FROM sessions s JOIN clicks e ON e.session_id = s.session_id LEFT JOIN products p ON p.product_id = e.product_id
)"""
DETAILS = """, details AS (
  SELECT o.order_id, o.customer_id, o.order_time, o.total_usd, i.product_id, i.quantity, p.category
  FROM sales o LEFT JOIN order_items i ON i.order_id = o.order_id LEFT JOIN products p ON p.product_id = i.product_id
)"""
MART = """, carts AS (
  SELECT session_id, product_id, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty FROM clicks WHERE event_type = 'add_to_cart' AND product_id IS NOT NULL GROUP BY 1, 2
), restored AS (
  SELECT e.event_id, e.session_id, e.timestamp, e.event_type, c.product_id, c.qty FROM clicks e JOIN carts c ON c.session_id = e.session_id WHERE e.event_type IN ('checkout', 'purchase')
), mart AS (
  SELECT s.customer_id AS user_id, x.product_id AS item_id, x.timestamp,
    CASE x.event_type WHEN 'page_view' THEN 1 WHEN 'add_to_cart' THEN 3 WHEN 'checkout' THEN 4 WHEN 'purchase' THEN 5 END AS score, x.event_type
  FROM (
    SELECT session_id, timestamp, event_type, product_id FROM clicks WHERE event_type NOT IN ('checkout', 'purchase') AND product_id IS NOT NULL
    UNION ALL SELECT session_id, timestamp, event_type, product_id FROM restored
  ) x LEFT JOIN sessions s ON s.session_id = x.session_id
)"""


@plan(" SELECT session_id, customer_id, start_time, end_time, n_events FROM sessions")
def sessionize_gap(t):
    return t.sessions


@plan(" SELECT event_id, session_id, user_id, timestamp, event_type, product_id, qty, amount_usd FROM clicks")
def adapter_events(t):
    return t.events


@plan(SESSION_EVENTS + " SELECT * FROM session_events")
def session_event_join(t):
    return prep.session_events(t.sessions, t.events, t.products)


@plan(DETAILS + " SELECT * FROM details")
def order_detail_join(t):
    return prep.order_details(t.orders, t.order_items, t.products)


@plan(MART + " SELECT * FROM restored")
def cart_restoration(t):
    return prep.restore_carts(t.events)


@plan(MART + " SELECT user_id, item_id, timestamp, CAST(score AS BIGINT) AS score, event_type FROM mart")
def event_score_mart(t):
    return prep.score_mart(t.events, t.sessions)


@plan(" SELECT event_type, count(*) AS n FROM clicks WHERE event_type NOT IN ('page_view', 'add_to_cart', 'checkout', 'purchase') GROUP BY 1")
def unmapped_event_types(t):
    return prep.unmapped_types(t.events)


@plan(MART + " SELECT user_id, item_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM mart GROUP BY 1, 2")
def user_item_scores(t):
    return prep.user_item_scores(prep.score_mart(t.events, t.sessions))


@plan(MART + " SELECT user_id, count(item_id) AS n_events, CASE WHEN count(item_id) >= 60 THEN 'heavy' ELSE 'cold' END AS user_type FROM mart GROUP BY 1")
def heavy_cold_split(t):
    return prep.heavy_cold(prep.score_mart(t.events, t.sessions), 60)


@plan(
    """ SELECT CAST(i.order_id AS INTEGER) AS "BillNo", p.product_name AS "Itemname", CAST(i.quantity AS INTEGER) AS "Quantity", strftime(o.order_time, '%Y-%m-%d') AS "Date",
  printf('%.2f', p.price_usd) AS "Price", CAST(o.customer_id AS INTEGER) AS "CustomerID", c.country AS "Country"
FROM order_items i JOIN sales o ON o.order_id = i.order_id JOIN products p ON p.product_id = i.product_id JOIN customers c ON c.customer_id = o.customer_id
WHERE p.product_name IS NOT NULL AND i.quantity IS NOT NULL AND p.price_usd IS NOT NULL AND c.country IS NOT NULL AND o.order_time IS NOT NULL"""
)
def basket_format(t):
    return prep.basket(t.order_items, t.orders, t.products, t.customers)


@plan(" SELECT cart.session_id, count(*) AS pairs FROM clicks cart JOIN clicks o ON o.session_id = cart.session_id WHERE cart.event_type = 'add_to_cart' AND o.event_type = 'checkout' AND cart.timestamp > o.timestamp GROUP BY 1")
def cart_after_checkout(t):
    return prep.carts_after_checkout(t.events)


@plan(
    """, expected AS (SELECT session_id, count(*) * 2 AS cart_size FROM clicks WHERE event_type = 'add_to_cart' GROUP BY 1),
q AS (SELECT session_id, sum(qty) AS qty FROM clicks WHERE event_type = 'add_to_cart' GROUP BY 1)
SELECT count(*) AS sessions, round(avg(CASE WHEN q.qty = cart_size THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM expected LEFT JOIN q USING (session_id)"""
)
def cart_size_reconciliation(t):
    expected = t.events.where("event_type = 'add_to_cart'").groupBy("session_id").agg((F.count(F.lit(1)) * 2).alias("cart_size"))
    return rounded(prep.cart_reconciliation(t.events, expected))


@plan(f"""{DETAILS}
SELECT 'customer' AS kind, count(DISTINCT customer_id) AS n FROM sales WHERE order_time >= '{ORDER_SPLIT}' AND customer_id NOT IN (SELECT customer_id FROM sales WHERE order_time < '{ORDER_SPLIT}')
UNION ALL SELECT 'product', count(DISTINCT product_id) FROM details WHERE order_time >= '{ORDER_SPLIT}' AND product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM details WHERE order_time < '{ORDER_SPLIT}' AND product_id IS NOT NULL)""")
def new_in_test(t):
    details = prep.order_details(t.orders, t.order_items, t.products)
    train, test = prep.split_by_time(details, "order_time", ORDER_SPLIT)
    new = prep.new_in_test(train, test, ["customer_id", "product_id"])
    return new["customer_id"].agg(F.lit("customer").alias("kind"), F.count("customer_id").alias("n")).unionByName(new["product_id"].agg(F.lit("product").alias("kind"), F.count("product_id").alias("n")))


@plan(f" SELECT CASE WHEN timestamp < '{EVENT_SPLIT}' THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT user_id) AS users FROM clicks GROUP BY 1")
def time_split(t):
    train, test = prep.split_by_time(t.events, "timestamp", EVENT_SPLIT)
    row = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return row(train, "train").unionByName(row(test, "test"))


@plan(""" SELECT DISTINCT user_id, item_id FROM (
  SELECT o.customer_id AS user_id, i.product_id AS item_id FROM sales o JOIN order_items i ON i.order_id = o.order_id
  UNION ALL SELECT user_id, product_id FROM clicks WHERE event_type IN ('page_view', 'add_to_cart') AND product_id IS NOT NULL)""")
def interaction_pairs(t):
    bought = t.orders.join(t.order_items, "order_id").select(F.col("customer_id").alias("user_id"), F.col("product_id").alias("item_id"))
    return prep.interaction_pairs(bought, t.events, ["page_view", "add_to_cart"])


@plan(" SELECT o.customer_id, p.product_name AS item_name, CAST(sum(i.quantity) AS BIGINT) AS quantity FROM sales o JOIN order_items i ON i.order_id = o.order_id JOIN products p ON p.product_id = i.product_id GROUP BY 1, 2")
def basket_quantities(t):
    return t.orders.join(t.order_items, "order_id").join(t.products, "product_id").groupBy("customer_id", F.col("product_name").alias("item_name")).agg(F.sum("quantity").alias("quantity"))


@plan(""" SELECT customer_id, CAST(floor(balance / 1000) AS BIGINT) AS balance_bin,
  CASE WHEN balance > 0 AND balance <= 1000 THEN '(0, 1000]' WHEN balance > 1000 AND balance <= 5000 THEN '(1000, 5000]' WHEN balance > 5000 THEN '(5000, inf]' END AS balance_range FROM customers""")
def value_bins(t):
    return t.customers.select("customer_id", width_bin("balance", 1000).alias("balance_bin"), right_bin("balance", [0, 1000, 5000]).alias("balance_range"))


@plan(f""" SELECT c.customer_id FROM customers c WHERE c.country IN ('NATION_1', 'NATION_7') AND c.segment NOT IN ('BUILDING') AND c.balance IS NOT NULL
  AND c.customer_id IN (SELECT customer_id FROM sales WHERE order_time >= '{ORDER_SPLIT}' AND order_time < '2001-01-01')""")
def cohort_filter(t):
    recent = t.orders.where((F.col("order_time") >= moment(ORDER_SPLIT)) & (F.col("order_time") < moment("2001-01-01"))).select("customer_id")
    return t.customers.where(F.col("country").isin("NATION_1", "NATION_7") & ~F.col("segment").isin("BUILDING") & F.col("balance").isNotNull()).join(recent, "customer_id", "left_semi").select("customer_id")


@plan(""" SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, CAST(isodow(min(timestamp)) - 1 AS BIGINT) AS first_weekday FROM clicks GROUP BY 1""")
def event_share(t):
    by = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("event_type", "n", r(100 * F.col("n") / F.col("total"), 4).alias("share"), weekday("first").alias("first_weekday"))


@plan(""" SELECT c.country, count(*) AS sessions, count(DISTINCT s.customer_id) AS customers FROM sessions s JOIN customers c ON c.customer_id = s.customer_id GROUP BY 1""")
def sessions_by_country(t):
    return t.sessions.join(t.customers, "customer_id").groupBy("country").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("customer_id").alias("customers"))
