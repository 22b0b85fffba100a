import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, graph, lightgcn, models, recommend


def toy_graph(spark, personas=True):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(u) + 2**40, int(i)) for u, i in zip(rng.integers(0, 15, 70), rng.integers(0, 10, 70), strict=True)})
    edges = spark.createDataFrame(pairs, "u long, i long")
    if not personas:
        return lightgcn.load_graph(edges)
    up = spark.createDataFrame([(u, f"p{u % 3}") for u in {u for u, _ in pairs}] + [(5, "p0")], "u long, p string")
    ip = spark.createDataFrame([(i, f"p{i % 3}", 1.2 + i / 10) for i in range(10)] + [(99, "p1", 2.0)], "i long, p string, lift double")
    return lightgcn.load_graph(edges, up, ip)


def slopes(model, loss, u, i, j):
    """Gradients by central differences of the loss of one batch, and those the model gives."""

    def value():
        final = model.forward()
        total, g_pos, g_neg = lightgcn.pair_loss(loss, (final[u] * final[i]).sum(1), (final[u] * final[j]).sum(1))
        grad = np.zeros_like(final)
        np.add.at(grad, u, g_pos[:, None] * final[i] + g_neg[:, None] * final[j])
        np.add.at(grad, i, g_pos[:, None] * final[u])
        np.add.at(grad, j, g_neg[:, None] * final[u])
        extra, found = model.backward(final, grad, u, i, j)
        return total + extra, found

    _, found = value()
    found = {k: v.copy() for k, v in found.items()}
    for key, values in model.values.items():
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 40)]:
            kept = values[at]
            values[at] = kept + 1e-5
            up = value()[0]
            values[at] = kept - 1e-5
            down = value()[0]
            values[at] = kept
            yield (up - down) / 2e-5, found[key][at]


@pytest.mark.parametrize("kind", ["uniform", "decay"])
def test_gradients_of_lightgcn(spark, kind):
    g = toy_graph(spark)
    model = lightgcn.LightGcn(g, 4, 2, kind, 0.05, 3)
    model.values["e"] *= 20
    u, i = g.u[:20], len(g.users) + g.i[:20]
    for want, got in slopes(model, "BPR", u, i, len(g.users) + (g.i[:20] + 1) % 10):
        assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize(("activation", "pooling", "loss", "penalty"), [("Sigmoid", "Sum", "BPR", 0.0), ("Tanh", "Concat", "CE", 0.0), ("None", "Max", "MSE", 0.0), ("Tanh", "Sum", "BPR", 0.7)])
def test_gradients_of_the_spectral_model(spark, activation, pooling, loss, penalty):
    check_spectral_gradients(spark, loss, activation, pooling, 0.05, penalty, 3)


@pytest.mark.parametrize(("activation", "pooling", "loss", "transform", "unit", "dropout"), [("None", "Product", "BPR", False, False, 0.0), ("Tanh", "Product", "MSE", True, True, 0.0), ("Sigmoid", "MLP1", "CE", False, True, 0.0), ("Tanh", "MLP3", "BPR", True, False, 0.4), ("Sigmoid", "Sum", "BPR", True, True, 0.0)])
def test_gradients_of_pooling_transformation_and_unit_rows(spark, activation, pooling, loss, transform, unit, dropout):
    check_spectral_gradients(spark, loss, activation, pooling, 0.05, 0.0, 3, transform, unit, dropout)


def check_spectral_gradients(spark, loss, *settings):
    g = toy_graph(spark)
    model = lightgcn.Spectral(g, models.largest_eigenvectors(g.norm, 6)[1], 3, 2, *settings)
    model.values = {k: v * 20 for k, v in model.values.items()}
    if model.dropout:  # the same entries are dropped in every call
        forward = model.forward
        model.forward = lambda: forward(np.random.default_rng(5))
    u, i = g.u[:15], len(g.users) + g.i[:15]
    for want, got in slopes(model, loss, u, i, len(g.users) + (g.i[:15] + 1) % 10):
        assert got == pytest.approx(want, rel=1e-3, abs=1e-5)


def test_spectral_variants_train_and_repeat(spark):
    g, truth = toy_graph(spark), {0: {1, 2}, 3: {4}}
    run = lambda pooling, **settings: lightgcn.train_spectral(g, truth, frequencies=6, dims=4, pooling=pooling, epochs=15, batch=16, negatives=2, rate=0.05, ks=(2,), **settings)
    kept = run("MLP2", unit=True, dropout=0.3)
    assert np.array_equal(kept.vectors, run("MLP2", unit=True, dropout=0.3).vectors)
    assert np.allclose(np.linalg.norm(kept.vectors, axis=1), 1) and kept.vectors.shape[1] == 4
    assert not np.array_equal(run("Sum").vectors, run("Sum", dropout=0.3).vectors)
    product = run("Product", transform=True)
    assert product.log[-1][4] < product.log[0][4]
    for pooling in ("MLP", "MLP0", "MLPx", "Mean"):
        with pytest.raises(ValueError):
            run(pooling)
    with pytest.raises(ValueError):
        run("Sum", dropout=1.0)


def test_dropped_entries_keep_the_mean():
    mask = lightgcn.dropout_mask(np.random.default_rng(2), (400, 50), 0.25)
    assert set(np.unique(mask)) == {0.0, 1 / 0.75} and mask.mean() == pytest.approx(1, abs=0.02)
    assert lightgcn.dropout_mask(None, (3, 2), 0.25) == 1.0


@pytest.mark.parametrize("optimisation", ["Adam", "SGD", "Adagrad", "RMSProp"])
def test_training_lowers_the_loss_and_repeats(spark, optimisation):
    g = toy_graph(spark, personas=optimisation != "SGD")
    truth = {0: {1, 2}, 3: {4}}
    run = lambda: lightgcn.train_lightgcn(g, truth, dims=8, epochs=25, batch=16, negatives=3, rate=0.05, optimisation=optimisation, ks=(2, 5))
    first, again = run(), run()
    assert first.log == again.log and np.array_equal(first.vectors, again.vectors)
    assert len(first.log) == 50 and first.log[-1][4] < first.log[0][4] and np.isfinite(first.vectors).all()
    assert first.vectors.shape == (sum(g.sizes), 8)


def test_draws_never_hit_what_a_user_has(spark):
    g = toy_graph(spark)
    histories, rng = lightgcn.Histories(g), np.random.default_rng(0)
    has = set(zip(g.u.tolist(), g.i.tolist(), strict=True))
    u = np.repeat(g.u[histories.open[g.u]], 30)
    drawn = histories.negatives(u, rng)
    assert len(drawn) == len(u) and not has & set(zip(u.tolist(), drawn.tolist(), strict=True))


def test_evaluation_equals_the_one_over_tables(spark):
    g = toy_graph(spark, personas=False)
    rng = np.random.default_rng(2)
    uv, iv = rng.normal(size=(len(g.users), 3)), rng.normal(size=(len(g.items), 3))
    truth = {0: {1, 5}, 2: {0}, 7: {3, 4, 9}}
    f1, ndcg = lightgcn.evaluate(g, uv, iv, truth, (2, 5), mask=False)
    frame = lambda v, key: spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(v)], f"{key} long, vec array<double>")
    recs = graph.score_top_n(frame(uv, "user_id"), frame(iv, "item_id"), spark.createDataFrame([], "user_id long, item_id long"), 5)
    want = {r["k"]: r for r in recommend.train_f1_ndcg(recs, spark.createDataFrame([(u, i) for u, s in truth.items() for i in s], "user_id long, item_id long"), (2, 5)).collect()}
    assert f1 == pytest.approx([want[2]["f1"], want[5]["f1"]]) and ndcg == pytest.approx([want[2]["ndcg"], want[5]["ndcg"]])


def test_too_many_edges_are_refused(spark):
    edges = spark.createDataFrame([(i, i) for i in range(20)], "u long, i long")
    with pytest.raises(ValueError):
        lightgcn.load_graph(edges, max_edges=10)
    with pytest.raises(ValueError):
        models.laplacian_vectors(edges.selectExpr("concat('u', u) AS src", "concat('i', i) AS dst", "1.0D AS w"), 2, max_edges=10)


@pytest.mark.parametrize("parts", [1, 3])
def test_eigenvectors_equal_the_dense_ones(parts):
    rng = np.random.default_rng(parts)
    n = 240
    a, b = rng.integers(0, n // parts, 900), rng.integers(0, n // parts, 900)
    part = rng.integers(0, parts, 900)
    a, b = a + part * (n // parts), b + part * (n // parts)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    deg = np.bincount(src, minlength=n).astype(float)
    half = np.divide(1, np.sqrt(deg), out=np.zeros(n), where=deg > 0)
    w = half[src] * half[dst]
    dense = np.zeros((n, n))
    np.add.at(dense, (src, dst), w)
    values, vectors = models.largest_eigenvectors(models.Sparse(src, dst, w, n), 12, most=60)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(dense))[::-1][:12], atol=1e-7)
    assert np.allclose(dense @ vectors, vectors * values, atol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-8)


def test_clusters_and_silhouettes_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id long, a double, b double").repartition(4)
    model = models.fit_kmeans(df, ["a", "b"], 3, 5)
    own = {r["customer_id"]: r["segment_id"] for r in models.assign_kmeans(model, df, ["a", "b"], "customer_id").collect()}
    assert len({own[i] for i in range(25)}) == 1 and sorted(model.sizes.tolist()) == [25, 25, 25]
    group = np.array([own[i] for i in range(75)])
    assert model.inertia == pytest.approx(sum(np.square(x[group == g] - x[group == g].mean(0)).sum() for g in range(3)))
    far = np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    value = []
    for i in range(75):
        inner = far[i][group == group[i]].sum() / 24
        outer = min(far[i][group == g].mean() for g in range(3) if g != group[i])
        value.append((outer - inner) / max(inner, outer))
    measures, sizes = models.k_sweep(df, ["a", "b"], [2, 3], 4)
    got = {r["k"]: r for r in measures.collect()}
    assert got[3]["silhouette"] == pytest.approx(np.mean(value)) and got[2]["inertia"] > got[3]["inertia"]
    assert {(r["k"], r["size"]) for r in sizes.collect() if r["k"] == 3} == {(3, 25)}


def test_large_ids_and_long_histories_in_als(spark):
    scores = spark.createDataFrame([(2**40 + u, 2**41 + i, 1 + (u + i) % 4) for u in range(8) for i in range(10) if (u + i) % 2 or u == 0 and i < 8], "user_id long, item_id long, score long")
    recs = models.als_top_n(models.fit_als(scores, rank=4, iterations=3), scores.select("user_id"), scores, 4)
    assert recs.join(scores, ["user_id", "item_id"]).count() == 0
    counts = {r["user_id"]: r["n"] for r in recs.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 8 and counts[2**40] == 1 and counts[2**40 + 1] == 4


def test_popular_lists_of_long_histories(spark):
    seen = spark.createDataFrame([(1, i) for i in range(1, 9)] + [(2, 3)], "user_id long, item_id long")
    popular = spark.createDataFrame([(i, 100 - i) for i in range(1, 11)], "item_id long, popularity long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in recommend.popular_top_n(users, seen, popular, 3).collect()}
    assert got == {(1, 1): 9, (1, 2): 10, (2, 1): 1, (2, 2): 2, (2, 3): 4, (3, 1): 1, (3, 2): 2, (3, 3): 3}


def test_pagerank_and_pruning_equal_dense_products(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(u), int(t)) for u, t in zip(rng.integers(0, 9, 40), rng.integers(0, 7, 40), strict=True)})
    e = spark.createDataFrame(pairs, "u long, t long")
    a = np.zeros((9, 7))
    for u, t in pairs:
        a[u, t] = 1
    step = (a / a.sum(1, keepdims=True)) @ (a / a.sum(0)).T
    start = spark.createDataFrame([(0, 1.0)], "v long, mass double")
    one = {r["v"]: r["mass"] for r in graph.pagerank_step(start, e).collect()}
    assert [one.get(v, 0) for v in range(9)] == pytest.approx(step[0].tolist())
    full = 0.999 * step + 0.001 / 9
    want = np.linalg.matrix_power(full.T, 200) @ np.eye(9)[0]
    got = {r["v"]: r["mass"] for r in graph.pagerank(e, start).collect()}
    assert [got[v] for v in range(9)] == pytest.approx(want.tolist(), abs=1e-8)
    mass = step.sum(0)
    left = sorted(range(9), key=lambda v: (round(mass[v], 12), v))[:-2]
    left = sorted(left, key=lambda v: (a[v].sum(), v))[:-3]
    assert sorted(r["u"] for r in graph.prune_scope(e, e.select("u"), 2, 3).collect()) == sorted(left)


def test_a_stopped_sampler_goes_on(spark):
    edges = spark.createDataFrame([(u, t) for u in range(12) for t in range(u % 5, u % 5 + 3)], "u long, t long")
    seeds, pool = spark.createDataFrame([(0,)], "u long"), edges.select("u").distinct()
    whole = models.sampler_run(edges, seeds, pool, 2, 3)
    part = models.sampler_run(edges, seeds, pool, 2, 1)
    rest = models.sampler_run(edges, seeds, pool, 2, 2, done=part)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rest.collect()))
    state = [tuple(r) for r in models.sampler_state(whole, edges).orderBy("round").collect()]
    assert [x[:2] for x in state] == [(0, 1), (1, 3), (2, 5), (3, 7)] and state[0][2] == 3


def test_nearest_centres_and_segmentations(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], "id long, vec array<double>")
    centres = spark.createDataFrame([(9, [0.0, 0.0]), (7, [0.0, 2.0]), (3, [5.0, 1.0])], "centre long, cvec array<double>")
    assert sorted(map(tuple, models.nearest_centre(points, "id", "vec", centres).collect())) == [(1, 7, 1.0), (2, 3, 4.0)]
    a = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "customer_id long, segment int")
    b = spark.createDataFrame([(1, 0), (2, 2), (3, 1), (4, 1)], "customer_id long, segment int")
    assert tuple(features.segmentation_match(a, b).first()) == (3, pytest.approx(1 / 3))


def test_blocks_of_items_give_the_same_lists(spark):
    rng = np.random.default_rng(6)
    frame = lambda n, key: spark.createDataFrame([(j, rng.integers(-3, 4, 3).astype(float).tolist()) for j in range(n)], f"{key} long, vec array<double>")
    users, items = frame(20, "user_id"), frame(30, "item_id")
    seen = spark.createDataFrame([(u, i) for u in range(20) for i in range(u % 7)], "user_id long, item_id long")
    lists = [sorted(map(tuple, graph.score_top_n(users, items, seen, 4, size).collect())) for size in (1000, 7)]
    assert lists[0] == lists[1] and len(lists[0]) == 80


def hub_graph(leaves, hubs, each, seed=1):
    """A graph whose leaves have edges to hubs only, and some edges between hubs: the dense matrix and its edges, normalised."""
    rng = np.random.default_rng(seed)
    key = np.unique(np.repeat(np.arange(leaves), each) * hubs + rng.integers(0, hubs, leaves * each))
    a, b = np.append(key // hubs, [leaves, leaves]), np.append(leaves + key % hubs, [leaves + 1, leaves + 2])
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(rng.random(len(a)) + 0.5, 2)
    half = 1 / np.sqrt(np.bincount(src, weights=w, minlength=leaves + hubs))
    w = w * half[src] * half[dst]
    dense = np.zeros((leaves + hubs, leaves + hubs))
    np.add.at(dense, (src, dst), w)
    return dense, models.Sparse(src, dst, w, leaves + hubs)


def test_eigenvectors_of_few_hubs_are_exact_and_cover_zeros():
    dense, matrix = hub_graph(400, 12, 4)
    values, vectors = models.largest_eigenvectors(matrix, 40, most=100)
    assert matrix.cover and len(matrix.cover.c) == 12
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(dense))[::-1][:40], atol=1e-12)
    assert np.allclose(dense @ vectors, vectors * values, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(40), atol=1e-12)


def test_products_in_parts_and_series_equal_dense_ones(monkeypatch):
    dense, matrix = hub_graph(60, 6, 3)
    rng = np.random.default_rng(4)
    x, rows, weights = rng.normal(size=(66, 5)), rng.permutation(66)[:20], [0.5, 0.3, 0.2, 0.7]
    some = np.zeros_like(x)
    some[rows] = x[rows]
    total = sum(w * np.linalg.matrix_power(dense, n) for n, w in enumerate(weights))
    plain = hub_graph(60, 6, 3)[1]
    plain.cover = None
    assert matrix.cover is not None
    monkeypatch.setattr(models, "CELLS", 40)  # eight edges at once
    for m in (matrix, plain):
        assert np.allclose(m @ x, dense @ x, atol=1e-12) and np.allclose(m.series(weights, x), total @ x, atol=1e-12)
        assert np.allclose(m.series(weights, x, wanted=rows), (total @ x)[rows], atol=1e-12)
        assert np.allclose(m.series(weights, x[rows], given=rows), total @ some, atol=1e-12)


def test_vectors_in_parts_keep_their_names(spark, monkeypatch):
    monkeypatch.setattr(models, "CELLS", 6)
    edges = spark.createDataFrame([(f"u{n % 7}", f"i{n % 3}", 1.0) for n in range(21)], "src string, dst string, w double")
    got = {r["node"]: r["vec"] for r in models.laplacian_vectors(edges, 2).collect()}
    assert sorted(got) == sorted([f"u{n}" for n in range(7)] + [f"i{n}" for n in range(3)]) and all(len(v) == 2 for v in got.values())
    for node, vec in got.items():  # the first vector is the root of the degrees, up to its sign
        assert abs(vec[0]) == pytest.approx(np.sqrt((3 if node[0] == "u" else 7) / 42))


@pytest.mark.parametrize("kind", ["lightgcn", "Sum", "Product", "MLP2"])
def test_a_batch_needs_only_the_rows_it_uses(spark, kind):
    g = toy_graph(spark)
    model = lightgcn.LightGcn(g, 4, 2, "uniform", 0.05, 3) if kind == "lightgcn" else lightgcn.Spectral(g, models.largest_eigenvectors(g.norm, 6)[1], 3, 2, "Tanh", kind, 0.05, 0.1, 3, True, True)
    u, i, j = g.u[:9], len(g.users) + g.i[:9], len(g.users) + (g.i[:9] + 1) % 10
    used, places = np.unique(np.concatenate([u, i, j]), return_inverse=True)
    final = model.forward()
    grad = np.zeros_like(final)
    grad[used] = np.random.default_rng(0).normal(size=(len(used), final.shape[1]))
    some = grad[used]
    value, want = model.backward(final, grad, u, i, j)
    part = model.forward(None, used)
    assert np.allclose(part, final[used], atol=1e-14)
    again, got = model.backward(part, some, *np.split(places, 3), used)
    assert again == pytest.approx(value) and sorted(got) == sorted(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_runs_in_tasks_equal_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 3)).tolist() + [[0.0, 0.0, 0.0]] * 50
    points = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(3)
    whole = models.cluster(points, 3, [2, 5], 4)
    jobs = []
    one_pass = models._one_pass
    monkeypatch.setattr(models, "_one_pass", lambda *a: jobs.append(1) or one_pass(*a))
    assert models.cluster(points, 3, [2], 2) and not jobs
    monkeypatch.setattr(models, "CELLS", 10)
    shared = models.cluster(points, 3, [2, 5], 4)
    assert jobs
    for k in (2, 5):
        assert np.allclose(whole[k].centres, shared[k].centres) and whole[k].sizes.tolist() == shared[k].sizes.tolist() and whole[k].inertia == pytest.approx(shared[k].inertia)


@pytest.mark.parametrize("settings", [{}, {"penalty": 0.1}, {"pooling": "MLP2", "transform": True, "unit": True, "dropout": 0.1}])
def test_spectral_training_holds_little_besides_its_own_state(monkeypatch, settings):
    rng, n, dims = np.random.default_rng(4), 40_000, 16
    u, i = np.nonzero(rng.random((n, 12)) < 0.2)
    u, i = u[:4000], i[:4000]
    src, dst = np.concatenate([u, n + i]), np.concatenate([n + i, u])
    g = lightgcn.Graph(np.arange(n), np.arange(12), np.array([]), u, i, models.Sparse(src, dst, np.full(len(src), 0.1), n + 12))
    basis = np.linalg.qr(rng.normal(size=(n + 12, 8)))[0]
    monkeypatch.setattr(lightgcn, "largest_eigenvectors", lambda *_, **__: (np.ones(8), basis))
    tracemalloc.start()
    try:
        out = lightgcn.train_spectral(g, {0: {1}}, frequencies=8, dims=dims, epochs=1, batch=1000, ks=(2,), **settings)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.isfinite(out.vectors).all() and out.vectors.shape == (n + 12, dims)
    assert peak < (30 if "pooling" in settings else 18) * n * dims * 4  # vectors, their gradient, a layer, two moments, results, and what a block makes


def test_penalty_in_blocks_equals_that_of_the_whole(monkeypatch):
    x = np.random.default_rng(3).normal(1, 2, (103, 5)) @ np.random.default_rng(4).normal(size=(5, 5))
    monkeypatch.setattr(lightgcn, "BLOCK", 7)
    value, mean, slope = lightgcn.correlation_terms(x)
    z = (x - x.mean(0)) / x.std(0)
    c = np.corrcoef(x.T) - np.eye(5)
    down = 2 * z @ c / len(x)
    assert value == pytest.approx(np.square(c).sum() / 2)
    assert np.allclose((x - mean) @ slope, (down - down.mean(0) - z * (down * z).mean(0)) / x.std(0))


@pytest.mark.parametrize("settings", [{}, {"penalty": 0.1}, {"pooling": "MLP2", "transform": True, "unit": True, "dropout": 0.1}])
def test_spectral_training_doesnt_depend_on_blocks(spark, monkeypatch, settings):
    run = lambda: lightgcn.train_spectral(toy_graph(spark), {0: {1, 2}, 3: {4}}, frequencies=6, dims=4, epochs=3, batch=16, negatives=2, rate=0.05, ks=(2,), **settings)
    whole = run()
    monkeypatch.setattr(lightgcn, "BLOCK", 3)
    parts, again = run(), run()
    assert np.allclose(whole.vectors, parts.vectors, atol=1e-3) and np.array_equal(parts.vectors, again.vectors)


def test_rows_of_length_one_are_told_apart(spark):
    """Behind small weights all rows point nearly the same way: scores must differ by less than 32 bits can hold."""
    g = toy_graph(spark)
    basis = models.largest_eigenvectors(g.norm, 6)[1]
    few, many = (lightgcn.Spectral(g, basis.astype(kind), 4, 2, "Sigmoid", "MLP2", 0.02, 0.0, 3, True, True, 0.0).vectors() for kind in (np.float32, np.float64))
    scores = many @ many.T
    assert np.ptp(scores) < 1e-4 and np.corrcoef((few @ few.T).ravel(), scores.ravel())[0, 1] > 1 - 1e-6


@pytest.mark.parametrize("optimisation", ["Adam", "SGD", "Adagrad", "RMSProp"])
def test_training_over_hubs_equals_training_over_edges(spark, monkeypatch, optimisation):
    monkeypatch.setattr(lightgcn, "LEAF_BLOCK", 1)  # many blocks, in threads
    out = []
    for model in (lightgcn.HubGcn, lightgcn.LightGcn):
        g = toy_graph(spark)
        out.append(lightgcn._train(g, model(g, 4, 2, "decay", 0.05, 3), {0: {1, 2}, 3: {4}}, 6, 16, 3, 0.05, optimisation, "BPR", (2, 5), 42))
    got, want = out
    assert np.allclose(got.log, want.log, rtol=1e-4, atol=1e-5) and np.allclose(got.vectors, want.vectors, rtol=1e-3, atol=1e-4)


def test_a_step_of_graph_training_makes_no_table_of_all_nodes():
    rng, n, dims = np.random.default_rng(4), 40_000, 16
    u, i = np.nonzero(rng.random((n, 12)) < 0.5)
    src, dst = np.concatenate([u, n + i]).astype(np.int32), np.concatenate([n + i, u]).astype(np.int32)
    g = lightgcn.Graph(np.arange(n), np.arange(12), np.array([]), u[:4000].astype(np.int32), i[:4000].astype(np.int32), models.Sparse(src, dst, np.full(len(src), 0.01), n + 12))
    assert lightgcn.train_lightgcn(g, {0: {1}}, dims=dims, epochs=1, batch=1000, ks=(2,), spend=True).vectors.shape == (n + 12, dims) and g.norm is None
    peaks, table = [], (n + 12) * dims * 4
    g.norm = models.Sparse(src, dst, np.full(len(src), 0.01), n + 12)
    model = (getattr(lightgcn, "HubGcn", None) or lightgcn.LightGcn)(g, dims, 2, "uniform", 0.02, 3)
    optimizer = lightgcn.Optimizer("Adam", 0.01)
    for step in range(3):
        rows = np.array([0, 1, n, n + 1])
        tracemalloc.start()
        final = model.forward(None, rows)
        model.learn(optimizer, model.backward(final, np.ones_like(final), np.array([0, 1]), np.array([2, 2]), np.array([3, 3]), rows)[1])
        model.forward(None, rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[-1] < table  # gradients of all nodes alone would be one


@pytest.mark.parametrize("personas", [False, True])
def test_training_reads_the_mart_once_and_has_the_same_graph(spark, monkeypatch, personas):
    from tidemark.operators import prep
    from tidemark.plans import models as plan_models
    from tidemark.plans.graphs import event_edges, tri_parts
    from tidemark.plans.recommend import truth_of
    from tidemark.sources.adapters import Retail

    t, seen = Retail(spark, "/root/testdata/sf0.001"), {}
    want = lightgcn.load_graph(event_edges(t).select("u", F.col("t").alias("i")), *(tri_parts(t)[1:] if personas else ()))
    truth = lightgcn.truth_indices(want, truth_of(t))
    marts, score_mart = [], prep.score_mart
    monkeypatch.setattr(prep, "score_mart", lambda *a: marts.append(1) or score_mart(*a))
    monkeypatch.setattr(lightgcn, "train_lightgcn", lambda g, truth, **_: seen.update(g=g, truth=truth))
    plan_models.trained(Retail(spark, "/root/testdata/sf0.001"), personas)
    got = seen["g"]
    assert len(marts) == 1 and seen["truth"] == truth and truth and got.sizes == want.sizes
    for a, b in ((got.users, want.users), (got.items, want.items), (got.personas, want.personas), (got.u, want.u), (got.i, want.i), (got.norm.dst, want.norm.dst), (got.norm.w, want.norm.w)):
        assert np.array_equal(a, b)
