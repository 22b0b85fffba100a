"""Customer features, windows, time series, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, models, prep, timeseries
from tidemark.plans.base import EVENT_AS_OF, ORDER_AS_OF, ORDER_SPLIT, moment, plan, rounded
from tidemark.plans.prep import DETAILS

SESSION_PART = f""", session_part AS (
  SELECT customer_id, date_sub('day', max(start_time), TIMESTAMP '{EVENT_AS_OF}') AS session_recency_days, count(DISTINCT session_id) AS n_sessions FROM sessions WHERE start_time <= '{EVENT_AS_OF}' GROUP BY 1
)"""
EVENT_PART = """, event_part AS (
  SELECT user_id AS customer_id, count(*) FILTER (event_type = 'page_view') AS n_page_view, count(*) FILTER (event_type = 'add_to_cart') AS n_add_to_cart,
    count(*) FILTER (event_type = 'checkout') AS n_checkout, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM clicks GROUP BY 1
)"""
VIEWS = """, views AS (
  SELECT e.user_id AS customer_id, p.category, count(*) AS n FROM clicks e JOIN products p ON p.product_id = e.product_id WHERE e.event_type = 'page_view' AND p.category IS NOT NULL GROUP BY 1, 2
), viewed AS (
  SELECT customer_id, category AS top_viewed_category FROM views QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category) = 1
)"""
ORDER_PART = f"""{DETAILS}, order_part AS (
  SELECT customer_id, date_sub('day', max(order_time), TIMESTAMP '{ORDER_AS_OF}') AS order_recency_days, count(*) AS n_orders, sum(total_usd) AS total_spend, avg(total_usd) AS avg_order_value
  FROM (SELECT DISTINCT customer_id, order_id, order_time, total_usd FROM details WHERE order_time <= '{ORDER_AS_OF}') GROUP BY 1
), bought AS (
  SELECT customer_id, category, sum(quantity) AS n FROM details WHERE category IS NOT NULL AND order_time <= '{ORDER_AS_OF}' GROUP BY 1, 2
), purchased AS (
  SELECT customer_id, category AS top_purchased_category FROM bought QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category) = 1
)"""
FEATURES = (
    SESSION_PART
    + EVENT_PART
    + VIEWS
    + ORDER_PART
    + """, features AS (
  SELECT c.customer_id, session_recency_days, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_page_view, 0) AS n_page_view, coalesce(n_add_to_cart, 0) AS n_add_to_cart, coalesce(n_checkout, 0) AS n_checkout,
    coalesce(n_purchase, 0) AS n_purchase, top_viewed_category, order_recency_days, coalesce(n_orders, 0) AS n_orders, coalesce(total_spend, 0.0) AS total_spend, avg_order_value, top_purchased_category
  FROM customers c LEFT JOIN session_part USING (customer_id) LEFT JOIN event_part USING (customer_id) LEFT JOIN viewed USING (customer_id) LEFT JOIN order_part USING (customer_id) LEFT JOIN purchased USING (customer_id)
)"""
)
SEGMENT = (
    FEATURES
    + """, view_dom AS (SELECT customer_id, max(n) * 1.0 / nullif(sum(n), 0) AS dominant_view_ratio, count(*) FILTER (n > 0) AS view_diversity FROM views GROUP BY 1),
buy_dom AS (SELECT customer_id, max(n) * 1.0 / nullif(sum(n), 0) AS dominant_purchase_ratio, count(*) FILTER (n > 0) AS purchase_diversity FROM bought GROUP BY 1),
segment_features AS (
  SELECT f.*, n_add_to_cart * 1.0 / nullif(n_page_view, 0) AS cart_per_view, n_purchase * 1.0 / nullif(n_add_to_cart, 0) AS purchase_per_cart, n_page_view * 1.0 / nullif(n_sessions, 0) AS views_per_session,
    n_purchase * 1.0 / nullif(n_page_view, 0) AS purchase_per_view, ln(1 + total_spend) AS log_total_spend, ln(1.0 + n_page_view) AS log_page_views,
    CAST(coalesce(top_viewed_category = top_purchased_category, false) AS BIGINT) AS category_match, dominant_view_ratio, coalesce(view_diversity, 0) AS view_diversity, dominant_purchase_ratio, coalesce(purchase_diversity, 0) AS purchase_diversity
  FROM features f LEFT JOIN view_dom USING (customer_id) LEFT JOIN buy_dom USING (customer_id)
)"""
)
DAILY = ", daily AS (SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day, sum(amount_usd) AS value FROM clicks GROUP BY 1)"


def customer_table(t):
    details = prep.order_details(t.orders, t.order_items, t.products)
    return features.customer_features(t.customers, t.sessions, t.events, t.products, details, moment(EVENT_AS_OF), moment(ORDER_AS_OF))


def segment_table(t):
    details = prep.order_details(t.orders, t.order_items, t.products).where(F.col("order_time") <= moment(ORDER_AS_OF))
    return features.segment_features(customer_table(t), features.category_counts(t.events, t.products, "page_view"), features.category_quantities(details))


def daily_sales(t):
    return t.events.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")).agg(F.sum("amount_usd").alias("value"))


def round_all(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@plan(SESSION_PART + " SELECT * FROM session_part")
def customer_session_features(t):
    return features.session_features(t.sessions, moment(EVENT_AS_OF))


@plan(EVENT_PART + " SELECT * FROM event_part")
def customer_event_features(t):
    return features.event_counts(t.events)


@plan(VIEWS + " SELECT * FROM viewed")
def top_viewed_category(t):
    return features.top_viewed(t.events, t.products)


@plan(ORDER_PART + f" SELECT customer_id, order_recency_days, n_orders, {round_all(['total_spend', 'avg_order_value'], 7)} FROM order_part")
def customer_order_features(t):
    return rounded(features.order_features(prep.order_details(t.orders, t.order_items, t.products), moment(ORDER_AS_OF)), 7)


@plan(ORDER_PART + " SELECT * FROM purchased")
def top_purchased_category(t):
    return features.top_purchased(prep.order_details(t.orders, t.order_items, t.products).where(F.col("order_time") <= moment(ORDER_AS_OF)))


@plan(FEATURES + f" SELECT * EXCLUDE (total_spend, avg_order_value), {round_all(['total_spend', 'avg_order_value'], 7)} FROM features")
def customer_features(t):
    return rounded(customer_table(t), 7)


@plan(
    SEGMENT
    + f" SELECT * EXCLUDE (total_spend, avg_order_value, cart_per_view, purchase_per_cart, views_per_session, purchase_per_view, log_total_spend, log_page_views, dominant_view_ratio, dominant_purchase_ratio), {round_all(['total_spend', 'avg_order_value', 'cart_per_view', 'purchase_per_cart', 'views_per_session', 'purchase_per_view', 'log_total_spend', 'log_page_views', 'dominant_view_ratio', 'dominant_purchase_ratio'], 7)} FROM segment_features"
)
def segment_features(t):
    return rounded(segment_table(t), 7)


@plan(VIEWS + " SELECT customer_id, round(max(n) * 1.0 / sum(n), 6) AS dominant_view_ratio, count(*) FILTER (n > 0) AS view_diversity FROM views GROUP BY 1")
def view_diversity(t):
    return rounded(features.dominance(features.category_counts(t.events, t.products, "page_view"), "dominant_view_ratio", "view_diversity"))


@plan(ORDER_PART + " SELECT customer_id, round(max(n) * 1.0 / sum(n), 6) AS dominant_purchase_ratio, count(*) FILTER (n > 0) AS purchase_diversity FROM bought GROUP BY 1")
def purchase_diversity(t):
    details = prep.order_details(t.orders, t.order_items, t.products).where(F.col("order_time") <= moment(ORDER_AS_OF))
    return rounded(features.dominance(features.category_quantities(details), "dominant_purchase_ratio", "purchase_diversity"))


@plan(
    SEGMENT
    + """ SELECT customer_id, round(coalesce(cart_per_view, 0), 4) AS cart_per_view, round(coalesce(purchase_per_view, 0), 4) AS purchase_per_view, round(coalesce(dominant_view_ratio, 0), 4) AS dominant_view_ratio,
  coalesce(session_recency_days, (SELECT coalesce(max(session_recency_days) + 1, 0) FROM segment_features)) AS session_recency_days,
  coalesce(order_recency_days, (SELECT coalesce(max(order_recency_days) + 1, 0) FROM segment_features)) AS order_recency_days FROM segment_features"""
)
def clustering_inputs(t):
    base = segment_table(t).select("customer_id", "cart_per_view", "purchase_per_view", "dominant_view_ratio", "session_recency_days", "order_recency_days")
    return rounded(features.fill_for_clustering(base, ["cart_per_view", "purchase_per_view", "dominant_view_ratio"], ["session_recency_days", "order_recency_days"]), 4)


WINDOWS = ", ".join(
    f"count(*) FILTER (order_time >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL {d} DAY) AS orders_{d}d, coalesce(sum(total_usd) FILTER (order_time >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL {d} DAY), 0) AS spend_{d}d" for d in (30, 90, 365)
)
ACTIVE = ", ".join(f"count(*) FILTER (timestamp >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL {d} DAY) AS events_{d}d" for d in (30, 90, 365))


@plan(
    f""", spent AS (SELECT customer_id, {WINDOWS} FROM sales WHERE order_time < '{ORDER_AS_OF}' AND order_time >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 365 DAY GROUP BY 1),
active AS (SELECT user_id AS customer_id, {ACTIVE} FROM clicks WHERE timestamp < '{EVENT_AS_OF}' GROUP BY 1)
SELECT customer_id, {", ".join(f"coalesce(orders_{d}d, 0) AS orders_{d}d, round(coalesce(spend_{d}d, 0), 2) AS spend_{d}d, coalesce(events_{d}d, 0) AS events_{d}d" for d in (30, 90, 365))}
FROM spent FULL JOIN active USING (customer_id)"""
)
def window_features_30_90_365(t):
    return rounded(window_table(t), 2)


def window_table(t):
    details = prep.order_details(t.orders, t.order_items, t.products)
    return features.windowed(details, t.events, moment(ORDER_AS_OF), moment(EVENT_AS_OF))


@plan(
    " SELECT days, round(100.0 * avg(CAST(customer_id IN (SELECT customer_id FROM sales WHERE order_time < '" + ORDER_AS_OF + "' AND order_time >= TIMESTAMP '" + ORDER_AS_OF + "' - to_days(CAST(days AS INTEGER))) AS DOUBLE)), 6) AS ordering_pct,"
    " round(100.0 * avg(CAST(customer_id IN (SELECT user_id FROM clicks WHERE timestamp < '" + EVENT_AS_OF + "' AND timestamp >= TIMESTAMP '" + EVENT_AS_OF + "' - to_days(CAST(days AS INTEGER))) AS DOUBLE)), 6) AS active_pct"
    " FROM customers CROSS JOIN (SELECT CAST(unnest([30, 90, 365]) AS BIGINT) AS days) GROUP BY 1"
)
def active_pct(t):
    return rounded(features.active_share(t.customers, window_table(t)))


SPEND_CLASS = "CASE WHEN s < 100000 THEN 0 WHEN s < 300000 THEN 1 ELSE 2 END"


@plan(
    f""", a AS (SELECT customer_id, {SPEND_CLASS} AS segment FROM (SELECT customer_id, sum(total_usd) AS s FROM sales WHERE order_time < '{ORDER_SPLIT}' GROUP BY 1)),
b AS (SELECT customer_id, {SPEND_CLASS} AS segment FROM (SELECT customer_id, sum(total_usd) AS s FROM sales GROUP BY 1))
SELECT count(*) AS customers, round(avg(CAST(a.segment = b.segment AS DOUBLE)), 6) AS match_rate FROM a JOIN b USING (customer_id)"""
)
def segmentation_match(t):
    """Spend classes from the orders before the split against those from all orders."""
    classes = lambda orders: orders.groupBy("customer_id").agg(F.sum("total_usd").alias("s")).select("customer_id", F.expr(SPEND_CLASS).alias("segment"))
    before, _ = prep.split_by_time(t.orders, "order_time", ORDER_SPLIT)
    return rounded(features.segmentation_match(classes(before), classes(t.orders)))


@plan(
    DAILY
    + """ SELECT day, round(value, 4) AS value, round(lag(value, 1) OVER o, 4) AS value_lag_1, round(lag(value, 7) OVER o, 4) AS value_lag_7,
  round(CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END, 4) AS value_roll_7_mean, round(CASE WHEN count(value) OVER w = 7 THEN stddev_samp(value) OVER w END, 4) AS value_roll_7_std, round(CASE WHEN count(value) OVER w = 7 THEN max(value) OVER w END, 4) AS value_roll_7_max,
  round(sin(2 * pi() * (isodow(day) - 1) / 7), 4) AS dow_sin, round(cos(2 * pi() * (isodow(day) - 1) / 7), 4) AS dow_cos, round(sin(2 * pi() * month(day) / 12), 4) AS month_sin, round(cos(2 * pi() * month(day) / 12), 4) AS month_cos,
  CAST(isodow(day) >= 6 AS BIGINT) AS is_weekend
FROM daily WINDOW o AS (ORDER BY day), w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
)
def time_features(t):
    daily = daily_sales(t)
    return rounded(timeseries.calendar_features(timeseries.rolling_features(timeseries.lag_features(daily, "day", "value", (1, 7)), "day", "value", (7,)), "day"), 4)


@plan(
    f""", b AS (SELECT total_usd AS v, 0 AS side FROM sales WHERE order_time < '{ORDER_SPLIT}' UNION ALL SELECT total_usd, 1 FROM sales WHERE order_time >= '{ORDER_SPLIT}'),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM b), c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT) + 1, 10) AS bin, count(*) FILTER (side = 0) AS e, count(*) FILTER (side = 1) AS a FROM b, e GROUP BY 1),
f AS (SELECT range AS bin, coalesce(c.e, 0) AS e, coalesce(c.a, 0) AS a FROM range(1, 11) LEFT JOIN c ON c.bin = range),
s AS (SELECT CASE WHEN e = 0 THEN 1e-4 ELSE e * 1.0 / sum(e) OVER () END AS p, CASE WHEN a = 0 THEN 1e-4 ELSE a * 1.0 / sum(a) OVER () END AS q FROM f)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s"""
)
def psi(t):
    train, test = prep.split_by_time(t.orders, "order_time", ORDER_SPLIT)
    return rounded(timeseries.psi(train, test, "total_usd"))


DRIFT = ("total_usd", "quantity", "line_total_usd")


@plan(
    ", x AS (SELECT o.order_time, o.total_usd, i.quantity, i.line_total_usd FROM sales o JOIN order_items i ON i.order_id = o.order_id), b AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, CASE WHEN order_time < '{ORDER_SPLIT}' THEN 0 ELSE 1 END AS side FROM x" for c in DRIFT)
    + """), e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM b GROUP BY 1),
c AS (SELECT feature, least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT) + 1, 10) AS bin, count(*) FILTER (side = 0) AS e, count(*) FILTER (side = 1) AS a FROM b JOIN e USING (feature) GROUP BY 1, 2),
f AS (SELECT x.feature, r.range AS bin, coalesce(c.e, 0) AS e, coalesce(c.a, 0) AS a FROM e x CROSS JOIN range(1, 11) r LEFT JOIN c ON c.feature = x.feature AND c.bin = r.range),
s AS (SELECT feature, CASE WHEN e = 0 THEN 1e-4 ELSE e * 1.0 / sum(e) OVER (PARTITION BY feature) END AS p, CASE WHEN a = 0 THEN 1e-4 ELSE a * 1.0 / sum(a) OVER (PARTITION BY feature) END AS q FROM f)
SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drifted FROM s GROUP BY 1"""
)
def drift_report(t):
    train, test = prep.split_by_time(t.orders.join(t.order_items, "order_id"), "order_time", ORDER_SPLIT)
    return rounded(timeseries.drift_report(train, test, list(DRIFT)))


PAIRS = [("n_page_view", "n_sessions"), ("n_page_view", "n_orders"), ("n_page_view", "total_spend"), ("n_sessions", "n_orders"), ("n_sessions", "total_spend"), ("n_orders", "total_spend")]


@plan(FEATURES + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM features" for a, b in PAIRS))
def corr_pairs(t):
    return rounded(timeseries.correlations(customer_table(t), ["n_page_view", "n_sessions", "n_orders", "total_spend"]))


@plan(FEATURES + " SELECT n_orders > 9 AS buyer, count(*) AS n, round(avg(n_sessions), 6) AS n_sessions_mean, round(median(n_sessions), 6) AS n_sessions_median, round(stddev_samp(n_sessions), 6) AS n_sessions_std FROM features GROUP BY 1")
def buyers_and_others(t):
    table = customer_table(t).withColumn("n_orders", F.col("n_orders") - 9)
    return rounded(features.bought_or_not(table, ["n_sessions"]))


@plan(" SELECT order_id, round(least(total_usd, (SELECT quantile_cont(total_usd, 0.99) FROM sales)), 4) AS total_usd FROM sales")
def clipped_orders(t):
    return rounded(features.clip_at_quantile(t.orders.select("order_id", "total_usd"), "total_usd"), 4)


@plan(" SELECT customer_id, segment, count(customer_id) OVER (PARTITION BY segment) AS group_size FROM customers")
def group_sizes(t):
    return features.rank_features(t.customers.select("customer_id", "segment"), "segment", "customer_id")


@plan(" SELECT customer_id, round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 6) AS balance FROM customers")
def standard_scale(t):
    return rounded(models.scale(t.customers.select("customer_id", "balance"), ["balance"]))


@plan(
    """, x AS (SELECT event_id, amount_usd, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM clicks),
m AS (SELECT median(amount_usd) AS v FROM x), k AS (SELECT kind AS kk FROM x WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
SELECT event_id, round(coalesce(amount_usd, v), 4) AS amount_usd, CAST(coalesce(kind, kk) = 'page_view' AS DOUBLE) AS kind_page_view, CAST(coalesce(kind, kk) = 'purchase' AS DOUBLE) AS kind_purchase FROM x, m, k"""
)
def impute_and_encode(t):
    base = t.events.select("event_id", "amount_usd", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return rounded(models.one_hot(models.impute(base, ["amount_usd"], ["kind"]), "kind", ["page_view", "purchase"]), 4)
