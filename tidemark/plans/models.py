"""Learned and sampled queries: checked by invariants, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import als, graph, lightgcn, models, prep, recommend
from tidemark.plans.base import EVENT_SPLIT, moment, plan, rounded
from tidemark.plans.features import segment_table
from tidemark.plans.graphs import event_edges, label_set, tri_parts
from tidemark.plans.recommend import encoded, list_recs, parts, truth_of
from tidemark.streaming import events as stream

CLUSTER = ["cart_per_view", "purchase_per_view", "dominant_view_ratio", "log_total_spend", "log_page_views", "order_recency_days"]


def cluster_inputs(t):
    from tidemark.operators.features import fill_for_clustering

    base = segment_table(t).select("customer_id", *CLUSTER)
    return models.scale(fill_for_clustering(base, CLUSTER[:-1], CLUSTER[-1:]), CLUSTER)


@plan()
def kmeans_segments(t):
    inputs = t.keep("cluster_inputs", cluster_inputs(t))
    return models.assign_kmeans(models.fit_kmeans(inputs, CLUSTER, 6), inputs, CLUSTER, "customer_id")


@plan()
def k_sweep(t):
    return models.k_sweep(cluster_inputs(t), CLUSTER)[0]


@plan()
def k_sweep_sizes(t):
    return models.k_sweep(cluster_inputs(t), CLUSTER)[1]


@plan()
def als_top_n(t):
    scores, users, items = encoded(t)
    return models.als_top_n(models.fit_als(scores, encoded=(users, items)), users, scores, 10)


@plan()
def heavy_cold_recommendations(t):
    """ALS for heavy users, popular items for cold ones, in one table."""
    scores, users, items = encoded(t)
    types = prep.heavy_cold(parts(t)[0].where("user_id IS NOT NULL"))
    model = models.als_top_n(models.fit_als(scores, encoded=(users, items)), types.where("user_type = 'heavy'"), scores, 10)
    popular = recommend.popular_top_n(types.where("user_type = 'cold'"), scores, recommend.popularity(scores), 10)
    return recommend.union_recommendations(model, popular, types)


def als_search(t, params):
    """HR and NDCG at 10 over the users of the truth by ALS parameters, best first: fits are tasks, or Spark's own where a task can't hold the scores."""
    scores, users, items = encoded(t)
    truth = t.keep("truth", truth_of(t))
    typed = t.keep("typed", models.typed_scores(scores, users, items))
    task = als.load(typed, users, items, truth, max(p["rank"] for p in params))
    if task:
        return als.run_all(t.spark, task, params)
    asked = t.keep("asked", truth.select("user_id").distinct())
    seen = t.keep("seen", scores.join(asked, "user_id", "left_semi"))
    for kept in (asked, seen):
        kept.count()

    def run(rank: int, reg: float, alpha: float, iterations: int) -> dict:
        model = models.fit_als(scores, rank, iterations, reg, alpha, encoded=(users, items), typed=typed)
        row = recommend.evaluate_at(models.als_top_n(model, asked, seen, 10), truth, (10,)).first()
        return {"hr": float(row["hr"]), "ndcg": float(row["ndcg"])} if row else {"hr": 0.0, "ndcg": 0.0}

    return models.grid(params, run)


ALS_ROW = "rank int, reg double, alpha double, iterations int, hr double, ndcg double"


def als_rows(t, found):
    return t.spark.createDataFrame([(r["rank"], r["reg"], r["alpha"], r["iterations"], r["hr"], r["ndcg"]) for r in found], ALS_ROW)


@plan()
def als_grid(t):
    return als_rows(t, als_search(t, [{**p, "iterations": 20} for p in models.combinations(models.ALS_GRID)]))


@plan()
def als_iterations(t):
    """HR and NDCG by the number of iterations, for the parameters of the production model."""
    return als_rows(t, als_search(t, [{"rank": 16, "reg": 0.1, "alpha": 0.5, "iterations": n} for n in models.ALS_ITERATIONS]))


@plan()
def bootstrap_ci(t):
    by = recommend.ranking_by_user(list_recs(t), truth_of(t), (5, 20)).groupBy("user_id").agg(F.max(F.when(F.col("k") == 5, F.col("recall"))).alias("a"), F.max(F.when(F.col("k") == 20, F.col("recall"))).alias("b"))
    return rounded(models.bootstrap_difference(by, "a", "b"))


@plan(" SELECT customer_id FROM customers ORDER BY md5(customer_id || ':42'), customer_id LIMIT 40")
def seeded_sample(t):
    return models.seeded_sample(t.customers.select("customer_id"), "customer_id", 40)


@plan()
def cross_validation(t):
    rows = t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id").withColumn("log_chars", F.log1p(F.col("n_chars").cast("double")))
    return models.cross_validate(models.stratified_folds(rows, "doc_id", "quality", 3), ["n_chars", "log_chars"], "quality", 3)


#: Epochs of the training queries; the operator's own default is what a full training takes.
EPOCHS = 20


def trained_pairs(t):
    """(u, i) of :func:`event_edges` and the rows of :func:`truth_of`, both from one pass over the scored mart."""
    mart = prep.score_mart(t.events, t.sessions).where("user_id IS NOT NULL")
    train, test = F.col("timestamp") < moment(EVENT_SPLIT), F.col("timestamp") >= moment(EVENT_SPLIT)
    kept = t.keep("trained_pairs", mart.groupBy("user_id", "item_id").agg(F.max(train).alias("train"), F.max(test & (F.col("event_type") == "purchase")).alias("bought")))
    truth = recommend.ground_truth(kept.where("bought").withColumn("event_type", F.lit("purchase")), kept.where("train"))
    return kept.where("train").select(F.col("user_id").alias("u"), F.col("item_id").alias("i")), truth


def persona_parts(t, edges, most: int = 100_000):
    """(u, p) and (i, p, lift) of the users and items that have an edge: the others' are no part of the graph."""
    items = edges.select(F.col("i").alias("item_id")).distinct()
    if items.count() <= most:
        items = F.broadcast(items)
    _, segments, lifts = tri_parts(t, items)
    return segments.join(edges.select("u").distinct(), "u", "left_semi"), lifts


def trained(t, personas: bool):
    """LightGCN on the events before the split, with segments as personas or without; the truth is what is bought after it."""
    edges, truth = trained_pairs(t)
    graph_ = lightgcn.load_graph(edges, *(persona_parts(t, edges) if personas else ()))
    return lightgcn.train_lightgcn(graph_, lightgcn.truth_indices(graph_, truth), epochs=EPOCHS, rate=0.01, spend=True)


@plan()
def lightgcn_training(t):
    return trained(t, False).log_frame(t.spark)


@plan()
def lightgcn_tri_training(t):
    return trained(t, True).log_frame(t.spark)


@plan()
def lightgcn_tri_top_n(t):
    users, items = trained(t, True).frames(t.spark)
    seen = trained_pairs(t)[0].select(F.col("u").alias("user_id"), F.col("i").alias("item_id"))
    return rounded(graph.score_top_n(users, items, seen, 10))


def spectral(t, penalty: float, **settings):
    graph_ = lightgcn.load_graph(event_edges(t).select("u", F.col("t").alias("i")), *tri_parts(t)[1:])
    truth = lightgcn.truth_indices(graph_, truth_of(t))
    return lightgcn.train_spectral(graph_, truth, frequencies=64, dims=32, epochs=EPOCHS // 2, rate=0.01, penalty=penalty, spend=True, **settings).log_frame(t.spark)


@plan()
def spectral_training(t):
    return spectral(t, 0.0)


@plan()
def spectral_afd_training(t):
    return spectral(t, 0.1)


@plan()
def spectral_mlp_training(t):
    return spectral(t, 0.0, pooling="MLP2", transform=True, unit=True, dropout=0.1)


@plan()
def laplacian_embedding(t):
    edges = event_edges(t).select(F.concat(F.lit("u"), "u").alias("src"), F.concat(F.lit("i"), "t").alias("dst"), F.lit(1.0).alias("w"))
    return models.laplacian_vectors(edges, 128)


def sampled(t, reverse: bool):
    edges = event_edges(t)
    users = edges.select("u").distinct()
    return models.sampler_run(edges, models.seeded_sample(users, "u", 6), users, 10, 3, t.keep("sampler_labels", label_set(t)), reverse=reverse)


@plan()
def sampler_run(t):
    return sampled(t, False)


@plan()
def sampler_run_rev(t):
    return sampled(t, True)


@plan()
def sampler_state(t):
    return models.sampler_state(sampled(t, False), event_edges(t))


@plan("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2", views=False)
def daily_counts(t):
    return rounded(stream.daily_counts(t.raw("events")), 4)


@plan("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER u IS NULL OR ts > lag(ts) OVER u + INTERVAL 1 DAY THEN 1 ELSE 0 END AS s FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS "start", max(ts) AS "last", count(*) AS n_events FROM n GROUP BY user_id, k""", views=False)
def session_windows(t):
    return stream.session_windows(t.raw("events"))


@plan("SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END) AS BIGINT) AS score FROM events GROUP BY 1", views=False)
def running_scores(t):
    return stream.running_scores(t.raw("events"), {"view": 1, "click": 3, "signup": 4, "purchase": 5})
