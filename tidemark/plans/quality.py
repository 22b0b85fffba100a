"""Segment profiles and quality, model metrics, data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models, plots, quality
from tidemark.plans.base import plan, rounded
from tidemark.plans.features import FEATURES, customer_table

ENTROPY = "count(*) AS groups, round(coalesce(-sum(share * log2(share)), 0), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(share * log2(share)) / log2(count(*)) END, 6) AS normalised, round(max(share), 6) AS concentration"


def with_segment(t):
    return customer_table(t).join(t.customers.select("customer_id", "segment"), "customer_id")


@plan(
    FEATURES
    + """, x AS (SELECT f.*, c.segment FROM features f JOIN customers c USING (customer_id))
SELECT segment, count(*) AS customers, round(avg(total_spend), 7) AS total_spend_mean, round(median(total_spend), 7) AS total_spend_median, round(avg(n_orders), 7) AS n_orders_mean, round(median(n_orders), 7) AS n_orders_median,
  round(count(*) * 1.0 / sum(count(*)) OVER (), 7) AS share FROM x GROUP BY 1"""
)
def segment_profile(t):
    return rounded(quality.profile(with_segment(t), "segment", ["total_spend", "n_orders"]), 7)


TOP_TEXT = """, n AS (SELECT segment, top_purchased_category AS c, count(*) AS n FROM features JOIN customers USING (customer_id) WHERE top_purchased_category IS NOT NULL GROUP BY 1, 2),
r AS (SELECT segment, c, n * 100.0 / sum(n) OVER (PARTITION BY segment) AS s, row_number() OVER (PARTITION BY segment ORDER BY n DESC, c) AS at_ FROM n)
SELECT segment, string_agg(printf('%s: %.1f%%', c, round(s, 1)), '; ' ORDER BY at_) AS top_categories FROM r WHERE at_ <= 3 GROUP BY 1"""


@plan(FEATURES + TOP_TEXT)
def top_category_text(t):
    return quality.top_category_text(with_segment(t), "segment", "top_purchased_category")


@plan(f", s AS (SELECT segment, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM customers WHERE segment IS NOT NULL GROUP BY 1) SELECT 'single' AS kind, {ENTROPY} FROM s")
def entropy_quality(t):
    return rounded(quality.quality_single(t.customers, "segment"))


MULTI = """, labels_of AS (SELECT customer_id, CASE WHEN balance < 0 THEN 'query_failed' ELSE 'ok' END AS status, [segment, country] AS personas FROM customers)"""


def label_rows(t):
    """Label rows of all customers: their segment and country; those with a debt count as failed queries."""
    return t.customers.select("customer_id", F.when(F.col("balance") < 0, "query_failed").otherwise("ok").alias("status"), F.array("segment", "country").alias("personas"))


@plan(f"{MULTI}, l AS (SELECT unnest(personas) AS label FROM labels_of WHERE status = 'ok'), s AS (SELECT label, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM l GROUP BY 1) SELECT 'multi' AS kind, {ENTROPY} FROM s")
def multi_label_quality(t):
    return rounded(quality.quality_multi(label_rows(t), "personas", "status"))


@plan(f"{MULTI} SELECT status, count(*) AS n FROM labels_of GROUP BY 1")
def status_roll_up(t):
    from tidemark.operators.personas import roll_up

    return roll_up(label_rows(t))


@plan(
    """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), centres AS (SELECT label AS centre, dim, avg(v) AS c FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, centre, sum((v - c) * (v - c)) AS d FROM e JOIN centres USING (dim) GROUP BY 1, 2)
SELECT vec_id, arg_min(centre, d) AS centre, round(sqrt(min(d)), 4) AS distance FROM d GROUP BY 1""",
    views=False,
)
def nearest_centroid(t):
    vectors = t.raw("embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("c"))
    centres = means.groupBy(F.col("label").alias("centre")).agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).getField("c").alias("cvec"))
    return rounded(models.nearest_centre(vectors, "vec_id", "embedding", centres), 4)


@plan(
    """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
r AS (SELECT a.dim AS i, b.dim AS j, corr(a.v, b.v) AS r FROM e a JOIN e b USING (vec_id) WHERE a.dim < b.dim GROUP BY 1, 2) SELECT round(sqrt(sum(r * r)), 5) AS norm FROM r""",
    views=False,
)
def embedding_correlation_norm(t):
    return rounded(quality.correlation_norm(t.raw("embeddings"), "embedding"), 5)


@plan(
    """WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem) SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs(y - p) / nullif(abs(y), 0)), 6) AS mape FROM x""",
    views=False,
)
def regression_metrics(t):
    x = t.raw("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return quality.regression_metrics(x, "y", "p").select(*[F.round(c, d).alias(c) for c, d in (("r2", 6), ("rmse", 4), ("mae", 4), ("mape", 6))])


@plan(
    """WITH x AS (SELECT toxic AS t, 1 - quality AS p FROM labels), c AS (SELECT DISTINCT t AS c FROM x UNION SELECT DISTINCT p FROM x),
f AS (SELECT c, count(*) FILTER (t = c) AS truth, count(*) FILTER (p = c) AS guess, count(*) FILTER (t = c AND p = c) AS hit FROM x, c GROUP BY 1)
SELECT round(sum(hit) * 1.0 / sum(truth), 6) AS accuracy, round(avg(2.0 * hit / nullif(truth + guess, 0)), 6) AS macro_f1, round(sum(2.0 * hit / nullif(truth + guess, 0) * truth) / sum(truth), 6) AS weighted_f1 FROM f""",
    views=False,
)
def classification_metrics(t):
    return rounded(quality.classification_metrics(t.raw("labels").select(F.col("toxic").alias("t"), (1 - F.col("quality")).alias("p")), "t", "p"))


@plan(
    """WITH x AS (SELECT toxic AS t, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2.0) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0)), 6) AS auc FROM r""",
    views=False,
)
def auc(t):
    return rounded(quality.auc(t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id"), "toxic", "n_chars"))


@plan(
    """WITH x AS (SELECT l_extendedprice - l_quantity * 1500.0 AS e FROM lineitem) SELECT round(avg(e), 3) AS mean, round(stddev_pop(e), 3) AS std, round(min(e), 3) AS min, round(max(e), 3) AS max, round(skewness(e), 3) AS skew, round(kurtosis(e), 3) AS kurtosis FROM x""",
    views=False,
)
def residual_summary(t):
    x = t.raw("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return rounded(quality.residual_summary(x, "y", "p"), 3)


DESCRIBE = "SELECT '{0}' AS feature, CAST(count(*) FILTER ({0} IS NULL) AS DOUBLE) AS nulls, CAST(count(DISTINCT {0}) AS DOUBLE) AS \"distinct\", round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, CAST(min({0}) AS DOUBLE) AS min, round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS median, round(quantile_cont({0}, 0.75), 4) AS q75, CAST(max({0}) AS DOUBLE) AS max FROM clicks"


@plan(" " + " UNION ALL ".join(DESCRIBE.format(c) for c in ("amount_usd", "qty", "product_id")))
def describe_columns(t):
    return rounded(quality.describe(t.events, ["amount_usd", "qty", "product_id"]), 4)


@plan(" SELECT order_id, product_id, count(*) AS n FROM order_items GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return quality.duplicates(t.order_items, ["order_id", "product_id"])


@plan(
    FEATURES
    + " SELECT rule, broken FROM (SELECT unnest([{'rule': 'negative count', 'broken': count(*) FILTER (n_sessions < 0 OR n_orders < 0 OR n_page_view < 0)}, {'rule': 'negative spend', 'broken': count(*) FILTER (total_spend < 0)},"
    " {'rule': 'negative recency', 'broken': count(*) FILTER (order_recency_days < 0 OR session_recency_days < 0)}, {'rule': 'repeated key', 'broken': count(*) - count(DISTINCT customer_id)}], recursive := true) FROM features)"
)
def integrity_checks(t):
    """Rows that break each rule of the customer table; :func:`quality.require_clean` raises on them."""
    return quality.rule_counts(quality.require_clean(customer_table(t), quality.CUSTOMER_RULES, ("customer_id",)), quality.CUSTOMER_RULES, ("customer_id",))


@plan(""", e AS (SELECT min(total_usd) AS lo, (max(total_usd) - min(total_usd)) / 20 AS w FROM sales) SELECT least(CAST(floor((total_usd - lo) / w) AS BIGINT) + 1, 20) AS bin, round(lo + (least(CAST(floor((total_usd - lo) / w) AS BIGINT) + 1, 20) - 1) * w, 4) AS low, round(lo + least(CAST(floor((total_usd - lo) / w) AS BIGINT) + 1, 20) * w, 4) AS high, count(*) AS n FROM sales, e GROUP BY 1, 2, 3""")
def histogram(t):
    return rounded(plots.histogram(t.orders, "total_usd"), 4)


@plan(" SELECT round(unnest(list_transform(range(20), lambda i: (i + 0.5) / 20)), 4) AS p, round(unnest(quantile_cont(total_usd, list_transform(range(20), lambda i: (i + 0.5) / 20))), 4) AS value FROM sales".replace("quantile_cont(total_usd, list_transform(range(20), lambda i: (i + 0.5) / 20))", "quantile_cont(total_usd, [" + ", ".join(str((i + 0.5) / 20) for i in range(20)) + "])").replace(", 4) AS value", ", 7) AS value"))
def quantile_points(t):
    return rounded(plots.quantile_points(t.orders, "total_usd"), 7)


@plan(""", x AS (SELECT l_extendedprice - l_quantity * 1500.0 AS e, l_quantity * 1500.0 AS p FROM lineitem), r AS (SELECT min(p) AS lo, max(p) AS hi FROM x) SELECT CAST(least(floor((p - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, round(avg(e), 3) AS mean, round(stddev_pop(e), 3) AS std, count(*) AS n FROM x, r GROUP BY 1""")
def residual_points(t):
    x = t.raw("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return rounded(plots.residual_points(x, "y", "p"), 3)


@plan("SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AS viewed, count(*) FILTER (event_type = 'click') > 0 AS carted, count(*) FILTER (event_type = 'purchase') > 0 AS bought FROM events GROUP BY 1", views=False)
def funnel_conversion(t):
    """Which steps of the funnel each user has reached."""
    some = lambda kind: (F.count_if(F.col("event_type") == kind) > 0)
    return t.raw("events").groupBy("user_id").agg(some("view").alias("viewed"), some("click").alias("carted"), some("purchase").alias("bought"))
