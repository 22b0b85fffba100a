import math
from math import log2, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, models, recommend

RECS = "user_id long, item_id long, rank long"


def test_encoding_is_dense_and_ordered(spark):
    got = {r["k"]: r["i"] for r in recommend.encode_ids(spark.createDataFrame([(x,) for x in (9000, 101, 5, 101, None, 8999)], "k long"), "k", "i").collect()}
    assert got == {5: 0, 101: 1, 8999: 2, 9000: 3}


def test_metric_points(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 99, 2), (1, 98, 3), (3, 1, 1), (3, 2, 2)], RECS)
    truth = spark.createDataFrame([(1, 10), (2, 5), (3, 1), (3, 2), (3, 3), (3, 4)], "user_id long, item_id long")
    got = {r["k"]: r for r in recommend.evaluate_at(recs, truth, (1, 3)).collect()}
    assert (got[3]["hr"], got[3]["recall"], got[3]["ndcg"], got[3]["eval_users"], got[3]["skipped"]) == (1.0, 0.75, 1.0, 2, 1)
    assert got[1]["recall"] == round((1 + 0.25) / 2, 4)
    assert recommend.evaluate_at(recs, truth, (3,), missing_as_zero=True).first()["hr"] == round(2 / 3, 4)
    late = recommend.ranking_by_user(spark.createDataFrame([(1, 7, 1), (1, 10, 2)], RECS), truth, (2,)).first()
    assert late["ndcg"] == pytest.approx(1 / log2(3)) and late["hits"] == 1


def test_train_metrics(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], RECS)
    truth = spark.createDataFrame([(1, 10), (1, 20)], "user_id long, item_id long")
    got = recommend.train_f1_ndcg(recs, truth, (2,)).first()
    assert got["f1"] == pytest.approx(0.5, abs=1e-6) and got["ndcg"] == pytest.approx(1 / (1 + 1 / log2(3)), abs=1e-6)


def test_popularity_leaves_out_what_was_seen(spark):
    seen = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "user_id long, item_id long")
    popular = spark.createDataFrame([(i, 10 - i) for i in range(1, 6)], "item_id long, popularity long")
    got = recommend.popular_top_n(seen, seen, popular, 2).collect()
    assert {(r["user_id"], r["item_id"], r["rank"]) for r in got} == {(1, 3, 1), (1, 4, 2), (2, 1, 1), (2, 2, 2)}


def test_weighting_keeps_the_cells(spark):
    m = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 2.0), (2, 2, 1.0)], "row long, col long, val double")
    for f in (recommend.tfidf_weight, recommend.bm25_weight):
        assert f(m).count() == 4
    assert {(r["row"], r["col"]): r["val"] for r in recommend.tfidf_weight(m).collect()}[0, 1] == pytest.approx(np.log(3) - np.log(2))


def purchases(spark, pairs):
    return spark.createDataFrame(pairs, "user_id long, item_id string")


@pytest.mark.parametrize(
    ("buyers", "want"),
    [((1, 2, 3, 4, 5), [(0, 3.0)]), ((1, 2, 3, 11, 12, 13), [(0, 1.5), (1, 1.5)]), ((1, 2, 3), []), ((1, 2, 11, 12, 21, 22), [])],
)
def test_lift(spark, buyers, want):
    segments = spark.createDataFrame([(c, (c - 1) // 10) for c in range(1, 31)], "customer_id long, segment long")
    got = graph.lift_edges(purchases(spark, [(b, "A") for b in buyers]), segments).collect()
    assert sorted((r["segment"], r["lift"]) for r in got) == want


def test_adjacency_keeps_all_users_and_drops_unknown_ids(spark):
    users = spark.createDataFrame([(101, 0), (102, 1), (103, 2)], "user_id long, uidx long")
    items = spark.createDataFrame([("x", 0), ("y", 1)], "item_id string, tidx long")
    pairs = purchases(spark, [(101, "y"), (101, "x"), (101, "y"), (999, "x"), (102, "zzz")])
    assert {r["uidx"]: r["items"] for r in graph.adjacency(pairs, users, items).collect()} == {0: [0, 1], 1: [], 2: []}


def test_propagation_weights_and_values(spark):
    assert graph.layer_weights(2, "uniform") == [1 / 3] * 3 and graph.layer_weights(2, "decay") == [1, 1 / 2, 1 / 3]
    with pytest.raises(ValueError):
        graph.layer_weights(2, "other")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "u long, i long")
    norm = graph.bipartite_norm(edges)
    w = {(r["src"], r["dst"]): r["w"] for r in norm.collect()}
    assert w["u0", "i1"] == pytest.approx(1 / 2) and w["i0", "u0"] == pytest.approx(1 / sqrt(2))
    nodes = ["u0", "u1", "i0", "i1"]
    a = np.array([[w.get((s, d), 0) for d in nodes] for s in nodes])
    start = np.arange(8).reshape(4, 2).astype(float)
    vecs = spark.createDataFrame([(n, start[j].tolist()) for j, n in enumerate(nodes)], "node string, vec array<double>")
    for kind in ("uniform", "decay"):
        ws = graph.layer_weights(2, kind)
        want = ws[0] * start + ws[1] * a @ start + ws[2] * a @ a @ start
        got = {r["node"]: r["vec"] for r in graph.propagate(norm, vecs, 2, 2, kind).collect()}
        assert np.allclose([got[n] for n in nodes], want)


def test_scoring_masks_seen_items(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    items = spark.createDataFrame([(5, [3.0, 1.0]), (6, [2.0, 5.0]), (7, [1.0, 0.0])], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(1, 5)], "user_id long, item_id long")
    for size in (100, 1):
        got = sorted((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in graph.score_top_n(users, items, seen, 2, size).collect())
        assert got == [(1, 1, 6, 2.0), (1, 2, 7, 1.0), (2, 1, 6, 5.0), (2, 2, 5, 1.0)]


def test_bpr_loss_is_finite_for_large_gaps(spark):
    vecs = spark.createDataFrame([("u", [100.0]), ("a", [1.0]), ("b", [-1.0])], "node string, vec array<double>")
    for pos, neg, want in (("a", "b", 0.0), ("b", "a", 200.0)):
        triple = spark.createDataFrame([("u", pos, neg)], "u string, pos string, neg string")
        assert graph.bpr_loss(triple, vecs, 1, 0.0).first()["loss"] == pytest.approx(want)


def toy(spark):
    rng = np.random.default_rng(0)
    edges = sorted({(int(u), int(t)) for u, t in zip(rng.integers(0, 12, 40), rng.integers(0, 8, 40), strict=True)})
    labels = [(u, f"p{u % 3}") for u in sorted({u for u, _ in edges})[::2]] + [(sorted({u for u, _ in edges})[0], "extra")]
    return edges, labels, spark.createDataFrame(edges, "u long, t long"), spark.createDataFrame(labels, "user_id long, persona string")


def test_reverse_walk_equals_the_forward_walk_times_labels(spark):
    edges, labels, e, lab = toy(spark)
    p = {(r["u"], r["v"]): r["p"] for r in graph.transition(e).collect()}
    users = sorted({u for u, _ in edges})
    assert all(sum(x for (a, _), x in p.items() if a == u) == pytest.approx(1) for u in users)
    n = {u: sum(a == u for a, _ in labels) for u in users}
    want = {}
    for u in users:
        for v, persona in labels:
            want[u, persona] = want.get((u, persona), 0) + p.get((u, v), 0) / n[v]
    got = {(r["u"], r["persona"]): r["score"] for r in graph.reverse_walk(e, lab).collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x})
    assert graph.reverse_walk(e, lab, threshold=10.0).count() == 0


def test_reverse_prediction_weighs_common_personas_down(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (4, "b")], "user_id long, persona string")
    scores = spark.createDataFrame([(9, "a", 0.6), (9, "b", 0.4)], "u long, persona string, score double")
    got = {r["persona"]: r["score"] for r in graph.reverse_prediction(scores, labels).collect()}
    assert got == pytest.approx({"a": 0.6, "b": 0.8})


def slow_gains(edges, labels, chosen):
    """Criterion 3 of every user that is not chosen, from pairs of users with teleport."""
    users, names = sorted({u for u, _ in edges}), sorted({p for u, p in labels if u in chosen})
    du, dt = ({k: sum(x[i] == k for x in edges) for k in {x[i] for x in edges}} for i in (0, 1))
    step = lambda u, v: 0.999 * sum(1 / du[u] / dt[t] for x, t in edges if x == u and (v, t) in edges) + 0.001 / len(users)
    q = {p: sum(1 for u, x in labels if u in chosen and x == p) for p in names}
    gains = {}
    for u in set(users) - set(chosen):
        raw = {p: sum(step(u, v) for v, x in labels if v in chosen and x == p) for p in names}
        share = {p: x / sum(raw.values()) for p, x in raw.items()}
        gains[u] = sum(-s * math.log(s) + q[p] / sum(q.values()) * math.log(q[p] / sum(q.values()) / s) for p, s in share.items())
    return gains


def test_sampler_ranks_by_information(spark):
    edges = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (4, 1), (5, 2), (5, 4), (6, 4), (7, 1), (7, 3), (7, 4)]
    labels = [(1, "a"), (2, "b"), (2, "a"), (3, "c"), (4, "a"), (5, "b"), (6, "c"), (7, "a")]
    e = spark.createDataFrame(edges, "u long, t long")
    lab, seeds = spark.createDataFrame(labels, "user_id long, persona string"), spark.createDataFrame([(1,), (2,)], "u long")
    run = models.sampler_run(e, seeds, e.select("u").distinct(), 1, 3, lab).where("round > 0").orderBy("round").collect()
    chosen = [1, 2]
    for r in run:
        gains = slow_gains(set(edges), labels, chosen)
        assert gains[r["u"]] == pytest.approx(max(gains.values()))
        chosen.append(r["u"])
    assert len(chosen) == 5
    back = [r["u"] for r in models.sampler_run(e, seeds, e.select("u").distinct(), 1, 3, lab, reverse=True).where("round = 1").collect()]
    assert back == [6]  # shares no item with users 1 and 2


@pytest.mark.parametrize("col_refine", [0.0, 0.5, 3.0])
def test_reverse_sampler_weighs_frequent_personas(spark, col_refine):
    edges = [(1, 1), (2, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 1), (5, 2), (5, 3), (1, 3), (6, 3), (6, 2), (7, 2), (7, 1)]
    edges, labels = sorted(set(edges)), [(1, "a"), (2, "a"), (3, "b"), (3, "a")]
    du, dt = ({k: sum(x[i] == k for x in edges) for k in {x[i] for x in edges}} for i in (0, 1))
    weight = {p: (3 / sum(x == p for _, x in labels)) ** col_refine for p in "ab"}
    gains = {}
    for u in (4, 5, 6, 7):
        raw = {p: weight[p] * sum(1 / du[u] / dt[t] / sum(x == v for x, _ in labels) for v, q in labels if q == p for x, t in edges if x == u and (v, t) in edges) for p in "ab"}
        share = {p: x / sum(raw.values()) for p, x in raw.items()}
        q = {"a": 3 / 4, "b": 1 / 4}
        gains[u] = sum((-share[p] * math.log(share[p]) if share[p] else 0) + q[p] * math.log(q[p] / (share[p] + 1e-16)) for p in "ab")
    e, lab = spark.createDataFrame(edges, "u long, t long"), spark.createDataFrame(labels, "user_id long, persona string")
    seeds, pool = spark.createDataFrame([(1,), (2,), (3,)], "u long"), spark.createDataFrame([(u,) for u in gains], "u long")
    run = models.sampler_run(e, seeds, pool, 1, 1, lab, reverse=True, col_refine=col_refine).where("round = 1").collect()
    assert [gains[r["u"]] for r in run] == pytest.approx([max(gains.values())])


def test_teleport_and_step(spark):
    _, _, e, _ = toy(spark)
    users = e.select("u").distinct().count()
    p = graph.transition(e)
    assert graph.with_teleport(p, users).agg(F.min("p")).first()[0] > 0.001 / users - 1e-12
    start = e.select(F.col("u").alias("v")).distinct().withColumn("mass", F.lit(1 / users))
    assert graph.pagerank_step(start, e).agg(F.sum("mass")).first()[0] == pytest.approx(1)


def test_rankings_for_the_sampler(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (3, 4), (3, 5)], "u long, t long")
    known = spark.createDataFrame([(1,)], "t long")
    got = {r["u"]: r["unseen"] for r in graph.coverage_rank(edges.select("u").distinct(), edges, known).collect()}
    assert got == {1: 1, 2: 0, 3: 3}
    run = models.sampler_run(edges, spark.createDataFrame([(1,)], "u long"), edges.select("u").distinct(), 1, 5)
    assert [r["u"] for r in run.orderBy("round").collect()] == [1, 2, 3]


def test_learned_operators_hold_their_invariants(spark):
    rows = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, float(i % 2)) for i in range(40)], "customer_id long, a double, b double")
    model = models.fit_kmeans(rows, ["a", "b"], 2, 2)
    got = models.assign_kmeans(model, rows, ["a", "b"], "customer_id").collect()
    assert len(got) == 40 and {r["segment_id"] for r in got} == {0, 1} and all(r["segment_id"] == r["customer_id"] % 2 for r in got)
    scaled = models.scale(rows.withColumn("c", F.lit(5.0)), ["a", "c"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("c").alias("c")).first()
    assert scaled["m"] == pytest.approx(0, abs=1e-9) and scaled["s"] == pytest.approx(1) and scaled["c"] == 0
    scores = spark.createDataFrame([(u, i, 1 + (u + i) % 4) for u in range(8) for i in range(10) if (u + i) % 2], "user_id long, item_id long, score long")
    recs = models.als_top_n(models.fit_als(scores, rank=4, iterations=3), scores.select("user_id"), scores, 3)
    assert recs.join(scores, ["user_id", "item_id"]).count() == 0
    for u in {r["user_id"] for r in recs.collect()}:
        ranks = sorted(r["rank"] for r in recs.where(F.col("user_id") == u).collect())
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 3
    edges = scores.select(F.col("user_id").alias("u"), F.col("item_id").alias("i"))
    items = recommend.encode_ids(scores, "item_id", "tidx")
    negative = models.sample_negatives(scores.select("user_id", "item_id"), items, 2)
    assert negative.count() == 2 * scores.count()
    assert negative.join(scores.select("user_id", F.col("item_id").alias("negative")), ["user_id", "negative"]).count() == 0
    assert models.seeded_sample(rows, "customer_id", 5).collect() == models.seeded_sample(rows.repartition(3), "customer_id", 5).collect()
    folds = models.stratified_folds(rows.withColumn("y", (F.col("customer_id") % 2)), "customer_id", "y", 4)
    assert {r["fold"] for r in folds.collect()} <= {0, 1, 2, 3}
    vecs = models.laplacian_vectors(edges.select(F.concat(F.lit("u"), "u").alias("src"), F.concat(F.lit("i"), "i").alias("dst"), F.lit(1.0).alias("w")), 2)
    assert vecs.count() == 18


def test_spectral_filter_pooling_and_losses(spark):
    rng = np.random.default_rng(4)
    basis, signal, extra = rng.normal(size=(5, 3)), rng.normal(size=(5, 2)), rng.normal(size=(5, 2))
    frame = lambda a: spark.createDataFrame([(f"n{j}", r.tolist()) for j, r in enumerate(a)], "node string, vec array<double>")
    values = lambda df: np.array([r["vec"] for r in sorted(df.collect())])
    kernel = [1.0, 0.5, 0.1]
    assert np.allclose(values(graph.spectral_filter(frame(basis), frame(signal), kernel, 2)), basis @ np.diag(kernel) @ basis.T @ signal)
    want = {"sum": signal + extra, "mean": (signal + extra) / 2, "max": np.maximum(signal, extra), "product": signal * extra, "concat": np.hstack([signal, extra])}
    for how, w in want.items():
        assert np.allclose(values(graph.pool_layers([frame(signal), frame(extra)], how)), w)
    pairs = spark.createDataFrame([("n0", "n1", 1.0), ("n2", "n3", 0.0)], "u string, i string, y double")
    s, y = np.array([signal[0] @ signal[1], signal[2] @ signal[3]]), np.array([1.0, 0.0])
    p = 1 / (1 + np.exp(-s))
    assert graph.pointwise_loss(pairs, frame(signal), 2, "mse").first()["loss"] == pytest.approx(((y - s) ** 2).mean())
    assert graph.pointwise_loss(pairs, frame(signal), 2, "ce").first()["loss"] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    for bad in (lambda: graph.pool_layers([frame(signal)], "x"), lambda: graph.pointwise_loss(pairs, frame(signal), 2, "x"), lambda: graph.graph_mode("x")):
        with pytest.raises(ValueError):
            bad()
    assert graph.graph_mode("tri")[0] == 6 and graph.graph_mode("bipartite")[0] == 0


@pytest.mark.parametrize("block_edges", [10_000, 40])
def test_walks_in_blocks_equal_dense_products_and_keep_ties_by_id(spark, block_edges):
    rng = np.random.default_rng(8)
    pairs = sorted({(int(u), int(t)) for u, t in zip(rng.integers(0, 30, 160), rng.integers(0, 40, 160), strict=True)} | {(u + 30, 50) for u in range(6)})
    edges = spark.createDataFrame([*pairs, (0, None)], "u long, t long")  # an unknown item counts among a user's
    a = np.zeros((36, 51))
    for u, t in pairs:
        a[u, t] = 1
    number = a.sum(1) + (np.arange(36) == 0)
    p = (a / number[:, None]) @ (a / np.maximum(1, a.sum(0))).T
    got = {(r["u"], r["v"]): r["p"] for r in graph.transition(edges, block_edges=block_edges).collect()}
    assert got == pytest.approx({(u, v): p[u, v] for u in range(36) for v in range(36) if p[u, v] > 0})
    ends = [v for v in range(36) if v % 3]
    near = graph.nearest_by_walk(edges, spark.createDataFrame([(v,) for v in ends], "u long"), 2, block_edges).collect()
    for u in range(36):
        best = sorted((v for v in ends if p[u, v] > 0), key=lambda v: (-round(p[u, v], 12), v))[:2]
        found = sorted((r["v"] for r in near if r["u"] == u), key=lambda v: (-round(p[u, v], 12), v))
        assert found[:2] == best
