import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, prep, quality, timeseries
from tidemark.sources import files
from tidemark.sources.adapters import sessionize

EVENTS = "event_id long, session_id long, user_id long, timestamp timestamp_ntz, event_type string, product_id long, qty long"
AT = dt.datetime(2025, 1, 1, 12)


def events(spark, rows):
    return spark.createDataFrame([(i, s, u, AT + dt.timedelta(minutes=m), kind, p, q) for i, (s, u, m, kind, p, q) in enumerate(rows)], EVENTS)


@pytest.fixture
def cart_events(spark):
    return events(spark, [(1, 7, 0, "add_to_cart", 10, 1), (1, 7, 1, "checkout", None, None), (1, 7, 2, "add_to_cart", 10, 2), (1, 7, 3, "add_to_cart", 11, 1), (1, 7, 4, "purchase", None, None), (2, 8, 0, "purchase", None, None), (2, 8, 1, "page_view", 12, None), (3, 9, 0, "error", 13, None)])


def test_carts_are_restored_regardless_of_time(cart_events):
    got = sorted((r["event_type"], r["product_id"], r["qty"]) for r in prep.restore_carts(cart_events).collect())
    assert got == [("checkout", 10, 3), ("checkout", 11, 1), ("purchase", 10, 3), ("purchase", 11, 1)]


def test_score_mart_keeps_unknown_types_without_score(spark, cart_events):
    sessions = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "session_id long, customer_id long")
    mart = prep.score_mart(cart_events, sessions)
    got = {(r["user_id"], r["item_id"], r["event_type"]): r["score"] for r in mart.collect()}
    assert got[9, 13, "error"] is None and got[8, 12, "page_view"] == 1 and got[7, 11, "purchase"] == 5
    assert {(r["user_id"], r["item_id"]): r["score"] for r in prep.user_item_scores(mart).collect()}[9, 13] == 0
    assert [r["event_type"] for r in prep.unmapped_types(cart_events).collect()] == ["error"]


def test_carts_after_checkout_and_split(cart_events):
    assert [(r["session_id"], r["pairs"]) for r in prep.carts_after_checkout(cart_events).collect()] == [(1, 2)]
    train, test = prep.split_by_time(cart_events, "timestamp", "2025-01-01 12:02:00")
    assert (train.count(), test.count()) == (5, 3)


def test_sessions_end_after_the_gap_not_at_it(spark):
    rows = [(1, 1, 0), (2, 1, 60), (3, 1, 121), (4, 2, 0)]
    df = spark.createDataFrame([(e, u, AT + dt.timedelta(seconds=s)) for e, u, s in rows], "event_id long, user_id long, ts timestamp_ntz")
    assert {r["event_id"]: r["session_no"] for r in sessionize(df, "user_id", "ts", 60).collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_customer_features_null_rules(spark):
    customers = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    products = spark.createDataFrame([(10, "b"), (11, "a"), (12, None)], "product_id long, category string")
    ev = events(spark, [(1, 1, 0, "page_view", 10, None), (1, 1, 1, "page_view", 11, None), (1, 1, 2, "page_view", 12, None)])
    sessions = spark.createDataFrame([(1, 1, AT)], "session_id long, customer_id long, start_time timestamp_ntz")
    details = spark.createDataFrame([(5, 1, dt.datetime(2025, 1, 1, 23), 10.0, 10, 1, "b"), (5, 1, dt.datetime(2025, 1, 1, 23), 10.0, 11, 2, "a"), (6, 2, dt.datetime(2025, 1, 1), 7.0, None, None, None)], "order_id long, customer_id long, order_time timestamp_ntz, total_usd double, product_id long, quantity long, category string")
    as_of = F.lit("2025-01-02").cast("timestamp_ntz")
    got = {r["customer_id"]: r for r in features.customer_features(customers, sessions, ev, products, details, as_of, as_of).collect()}
    assert (got[1]["order_recency_days"], got[1]["n_orders"], got[1]["total_spend"], got[1]["top_purchased_category"], got[1]["top_viewed_category"]) == (0, 1, 10.0, "a", "a")
    assert (got[2]["n_sessions"], got[2]["session_recency_days"], got[2]["top_purchased_category"], got[2]["total_spend"]) == (0, None, None, 7.0)
    assert (got[3]["total_spend"], got[3]["n_orders"], got[3]["avg_order_value"], got[3]["order_recency_days"]) == (0.0, 0, None, None)
    table = features.segment_features(customers.join(spark.createDataFrame([tuple(r) for r in got.values()], "customer_id long, session_recency_days long, n_sessions long, n_page_view long, n_add_to_cart long, n_checkout long, n_purchase long, top_viewed_category string, order_recency_days long, n_orders long, total_spend double, avg_order_value double, top_purchased_category string"), "customer_id"), features.category_counts(ev, products, "page_view"), features.category_quantities(details))
    rows = {r["customer_id"]: r for r in table.collect()}
    assert rows[1]["purchase_per_cart"] is None and rows[1]["category_match"] == 1 and rows[1]["dominant_purchase_ratio"] == pytest.approx(2 / 3) and rows[3]["dominant_view_ratio"] is None
    filled = {r["customer_id"]: r for r in features.fill_for_clustering(table, ["dominant_view_ratio"], ["order_recency_days"]).collect()}
    assert filled[3]["dominant_view_ratio"] == 0 and filled[3]["order_recency_days"] == filled[2]["order_recency_days"] + 1 == 2


def series(spark, n=100):
    return spark.createDataFrame([(AT + dt.timedelta(days=i), float((i * 37) % 17) if i != 50 else None) for i in range(n)], "day timestamp_ntz, value double")


def test_lags_and_rolling_windows_do_not_leak(spark):
    df = series(spark)
    rows = timeseries.rolling_features(timeseries.lag_features(df, "day", "value", (1, 7)), "day", "value", (7,)).orderBy("day").collect()
    values = [r["value"] for r in rows]
    for i, r in enumerate(rows):
        assert r["value_lag_1"] == (values[i - 1] if i else None)
        past = values[max(0, i - 7) : i]
        full = len(past) == 7 and None not in past
        assert r["value_roll_7_mean"] == (pytest.approx(sum(past) / 7) if full else None) and r["value_roll_7_max"] == (max(past) if full else None)
    assert df.columns == ["day", "value"]
    sunday = timeseries.calendar_features(spark.createDataFrame([(dt.datetime(2023, 1, 1),)], "day timestamp_ntz"), "day").first()
    assert sunday["is_weekend"] == 1 and sunday["dow_cos"] == pytest.approx(0.6234898)


def test_psi(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("v"))
    assert timeseries.psi(df, df, "v").first()["psi"] < 0.01
    assert timeseries.psi(df, df.select((F.col("v") + 25).alias("v")), "v").first()["psi"] > 0.2
    assert {r["feature"]: r["drifted"] for r in timeseries.drift_report(df, df, ["v"]).collect()} == {"v": False}


def test_redundant_pairs(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2 + 1).alias("b"), (F.col("id") % 3).alias("c"))
    assert [(r["a"], r["b"]) for r in timeseries.redundant_pairs(df, ["a", "b", "c"]).collect()] == [("a", "b")]


def test_integrity(spark):
    df = spark.createDataFrame([(1, 5), (1, -1)], "customer_id long, n long")
    with pytest.raises(quality.IntegrityError, match="negative: 1.*repeat.*instead of 3"):
        quality.require_clean(df, {"negative": "n < 0"}, ("customer_id",), 3)
    assert quality.require_clean(df, {}, (), 2) is df
    with pytest.raises(quality.IntegrityError):
        quality.check_assignment(spark.createDataFrame([(1, 6)], "customer_id long, segment_id long"), 6, 1)


def test_residual_moments_are_bias_corrected(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in (1, 2, 4, 9)], "y double, p double")
    got = quality.residual_summary(df, "y", "p").first()
    assert got["skew"] == pytest.approx(1.3309, abs=1e-3) and got["kurtosis"] == pytest.approx(1.5, abs=0.06)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cup", 2, "2025-01-01", "3.50", 7, "US"), (2, None, 1, "2025-01-01", "1.00", 7, "US"), (3, "jar", 1, "2025-01-02", "1.00", 8, "DE")], files.BASKET)
    files.write_csv(rows, f"{tmp_path}/basket", sep=";")
    assert [r["BillNo"] for r in files.read_basket(spark, f"{tmp_path}/basket", "US").collect()] == [1]
    with pytest.raises(ValueError):
        files.read_basket(spark, f"{tmp_path}/basket", "XX")
    edges = spark.createDataFrame([(0, 5), (0, 3), (1, 5), (0, 5)], "src long, dst long")
    files.write_adjacency(edges, f"{tmp_path}/graph")
    assert sorted(map(tuple, files.read_adjacency(spark, f"{tmp_path}/graph").collect())) == [(0, 3), (0, 5), (1, 5)]
    recs = spark.createDataFrame([(1, 2, 0.5, 1)], "user_id long, item_id long, score double, rank long")
    files.write_recommendations(recs, f"{tmp_path}/recs", "gcn", "tri")
    files.write_recommendations(recs, f"{tmp_path}/recs", "gcn", "bi")
    assert {r["graph_mode"] for r in spark.read.parquet(f"{tmp_path}/recs").collect()} == {"tri", "bi"}
    with pytest.raises(ValueError, match="rank"):
        files.write_recommendations(recs.drop("rank"), f"{tmp_path}/recs", "gcn", "tri")
    assert [files.save_run(recs, f"{tmp_path}/runs") for _ in range(3)] == [1, 2, 3]
    files.promote(spark, f"{tmp_path}/runs", 2, f"{tmp_path}/best")
    assert spark.read.parquet(f"{tmp_path}/best").columns == recs.columns
    assert files.merge_config({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}


def test_nodes_without_edges_stay_in_an_adjacency(spark, tmp_path):
    edges = spark.createDataFrame([(1, 5), (1, 3)], "src long, dst long")
    files.write_adjacency(edges, f"{tmp_path}/g", nodes=spark.createDataFrame([(7,), (1,)], "src long"))
    assert sorted(map(tuple, files.read_adjacency_lists(spark, f"{tmp_path}/g").collect())) == [(1, [3, 5]), (7, [])]
    assert sorted(map(tuple, files.read_adjacency(spark, f"{tmp_path}/g").collect())) == [(1, 3), (1, 5)]


def test_settings_come_from_files(tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: 9\npaths:\n  input: data/x.csv\n")
    got = files.load_config("c.yaml", {"a": {"b": 1, "c": 2}, "paths": {"input": "y", "out": "/abs"}}, tmp_path)
    assert got == {"a": {"b": 9, "c": 2}, "paths": {"input": f"{tmp_path}/data/x.csv", "out": "/abs"}}
    assert files.load_config(None, {"paths": {"p": "q"}}, "/r") == {"paths": {"p": "/r/q"}}
    with pytest.raises(FileNotFoundError):
        files.load_config("none.yaml", {}, tmp_path)


def test_metric_sheets_are_replaced(spark, tmp_path):
    for value in (1.0, 2.0):
        files.write_metric_sheet(spark.createDataFrame([(1, value)], "epoch int, x double"), f"{tmp_path}/log", "F1")
    files.write_metric_sheet(spark.createDataFrame([(1, 5.0)], "epoch int, x double"), f"{tmp_path}/log", "Loss")
    assert sorted((r["sheet"], r["x"]) for r in files.read_metric_log(spark, f"{tmp_path}/log").collect()) == [("F1", 2.0), ("Loss", 5.0)]
