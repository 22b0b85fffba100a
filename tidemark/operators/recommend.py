"""Recommendation: encodings, weighting, popularity, ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio

BM25_K1, BM25_B = 1.2, 0.75


def encode_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with a dense index from 0, in ascending order of the key.

    Indices come from counts by range bucket, added up, so no task numbers all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    bucket = F.floor(F.col(key) / 4096) if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.substring(key, 1, 2)
    binned = keys.withColumn("__b", bucket)
    sizes = binned.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return binned.withColumn("__r", inside).join(base, "__b").select(key, (F.col("__r") - 1 + F.coalesce("__base", F.lit(0))).cast("long").alias(name))


def coordinates(scores: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id", value: str = "score") -> DataFrame:
    """Sparse matrix in long form (row, col, val) with encoded ids."""
    return scores.join(users, user).join(items, item).select(F.col("uidx").alias("row"), F.col("tidx").alias("col"), F.col(value).cast("double").alias("val"))


def tfidf_weight(m: DataFrame) -> DataFrame:
    """Row-wise documents, column-wise terms: sqrt(val) times ln(N) - ln(1 + df); N counts the rows."""
    rows = m.agg(F.count_distinct("row").alias("__n"))
    df = m.groupBy("col").agg(F.count(F.lit(1)).alias("__df"))
    return m.join(df, "col").crossJoin(F.broadcast(rows)).select("row", "col", (F.sqrt("val") * (F.log(F.col("__n").cast("double")) - F.log1p(F.col("__df").cast("double")))).alias("val"))


def bm25_weight(m: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Saturated values with row-length normalisation, times the same inverse frequency."""
    lengths = m.groupBy("row").agg(F.sum("val").alias("__len"))
    means = lengths.agg(F.avg("__len").alias("__avg"), F.count(F.lit(1)).alias("__n"))
    df = m.groupBy("col").agg(F.count(F.lit(1)).alias("__df"))
    idf = F.log(F.col("__n").cast("double")) - F.log1p(F.col("__df").cast("double"))
    norm = (1 - b) + b * F.col("__len") / F.col("__avg")
    return m.join(lengths, "row").join(df, "col").crossJoin(F.broadcast(means)).select("row", "col", (F.col("val") * (k1 + 1) / (k1 * norm + F.col("val")) * idf).alias("val"))


def popularity(scores: DataFrame, item: str = "item_id", value: str = "score") -> DataFrame:
    """Items by summed score, with a rank; ties go to the smaller id."""
    return scores.groupBy(item).agg(F.sum(value).alias("popularity"))


def top_items(popular: DataFrame, n: int, item: str = "item_id") -> DataFrame:
    """The n most popular items (a top-n sort, no window over all items)."""
    return popular.orderBy(F.desc("popularity"), F.asc(item)).limit(n)


def popular_top_n(users: DataFrame, seen: DataFrame, popular: DataFrame, n: int) -> DataFrame:
    """By user, the n most popular items not seen yet.

    A user with h items seen needs no more than the first n + h items: each user asks for that many places of the
    list by a join, so the rows grow with the users and with what they have seen, not with the longest history.
    """
    own = seen.select("user_id", "item_id").distinct()
    histories = users.select("user_id").distinct().join(own.groupBy("user_id").agg(F.count(F.lit(1)).alias("h")), "user_id", "left")
    asked = histories.select("user_id", (F.lit(n) + F.coalesce("h", F.lit(0))).alias("places"))
    longest = asked.agg(F.max("places")).first()[0] or 0
    by_rank = Window.orderBy(F.desc("popularity"), F.asc("item_id"))  # ids and sums only, no longer than a history
    head = top_items(popular, longest).select("item_id", "popularity", F.row_number().over(by_rank).alias("place"))
    offered = asked.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), "places")).alias("place")).join(head, "place")
    left = offered.join(own, ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("place")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("user_id", "item_id", F.col("popularity").cast("double").alias("score"), "rank")


def union_recommendations(heavy: DataFrame, cold: DataFrame, user_types: DataFrame) -> DataFrame:
    """One table (user_id, item_id, score, rank, user_type): the model's list for heavy users, the popular one for cold users."""
    columns = ("user_id", "item_id", "score", "rank", "user_type")
    typed = lambda recs, kind: recs.join(user_types.where(F.col("user_type") == kind).select("user_id", "user_type"), "user_id").select(*columns)
    return typed(heavy, "heavy").unionByName(typed(cold, "cold"))


def evaluation_dump(recs: DataFrame, truth: DataFrame, n: int = 100) -> DataFrame:
    """By user of the truth, its wanted items in order and the first n recommended by rank; no recommendation is an empty list."""
    wanted = truth.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("truth"))
    lists = recs.where(F.col("rank") <= n).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).getField("item_id").alias("recommended"))
    return wanted.join(lists, "user_id", "left").select("user_id", "truth", F.coalesce("recommended", F.array().cast("array<bigint>")).alias("recommended"))


def top_n(scored: DataFrame, n: int, user: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """By user, the n best items with ranks from 1; ties go to the smaller id."""
    order = Window.partitionBy(user).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def ground_truth(test: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct purchases of the test rows whose user and item both occur in training."""
    bought = test.where(F.col("event_type") == "purchase").select("user_id", "item_id").distinct()
    return bought.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("item_id").distinct(), "item_id", "left_semi").select("user_id", "item_id")


def _gain(upto: int) -> list[float]:
    from math import log2

    total, out = 0.0, [0.0]
    for i in range(1, upto + 1):
        total += 1 / log2(i + 1)
        out.append(total)
    return out


def ranking_by_user(recs: DataFrame, truth: DataFrame, ks: Sequence[int], missing_as_zero: bool = False) -> DataFrame:
    """By user of the truth and k: hits, hit, recall and NDCG, in one pass over the recommendations.

    The ideal list has min(truth, recommended within k) entries. Users without recommendations are left
    out, or score 0.
    """
    per_user = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    upto = recs.where(F.col("rank") <= max(ks)).select("user_id", "item_id", "rank")
    marked = upto.join(truth.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left")
    parts = [x for k in ks for x in (F.count_if(F.col("rank") <= k).alias(f"n_{k}"), F.count_if((F.col("rank") <= k) & (F.col("hit") == 1)).alias(f"h_{k}"), F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g_{k}"))]
    by = per_user.join(marked.groupBy("user_id").agg(*parts), "user_id", "left" if missing_as_zero else "inner").na.fill(0)
    ideal = F.array(*[F.lit(x) for x in _gain(max(ks))])
    row = lambda k: F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h_{k}").alias("hits"), (F.col(f"h_{k}") > 0).cast("double").alias("hr"), ratio(f"h_{k}", "n_truth").alias("recall"), F.coalesce(F.try_divide(F.col(f"g_{k}"), F.element_at(ideal, (F.least("n_truth", f"n_{k}") + 1).cast("int"))), F.lit(0.0)).alias("ndcg"))
    return by.select("user_id", F.explode(F.array(*[row(k) for k in ks])).alias("x")).select("user_id", "x.*")


def evaluate_at(recs: DataFrame, truth: DataFrame, ks: Sequence[int] = (5, 10, 20), missing_as_zero: bool = False) -> DataFrame:
    """k, HR, Recall, NDCG (4 digits), users evaluated and skipped."""
    users = truth.agg(F.count_distinct("user_id").alias("__all"))
    by = ranking_by_user(recs, truth, ks, missing_as_zero).groupBy("k").agg(F.round(F.avg("hr"), 4).alias("hr"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.count(F.lit(1)).alias("eval_users"))
    return by.crossJoin(F.broadcast(users)).select("k", "hr", "recall", "ndcg", "eval_users", (F.col("__all") - F.col("eval_users")).alias("skipped"))


def train_f1_ndcg(recs: DataFrame, truth: DataFrame, ks: Sequence[int] = (2, 5, 10, 20, 50, 100), eps: float = 1e-10) -> DataFrame:
    """F1 and NDCG as tracked in training: precision over k, ideal list of min(truth, k) entries."""
    sizes = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    by = ranking_by_user(recs, truth, ks)
    gains = recs.join(truth, ["user_id", "item_id"]).select("user_id", "rank")
    dcg = gains.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias("g")) for k in ks])).alias("x")).groupBy("user_id", F.col("x.k").alias("k")).agg(F.sum("x.g").alias("g"))
    ideal = F.array(*[F.lit(x) for x in _gain(max(ks))])
    joined = by.join(sizes, "user_id").join(dcg, ["user_id", "k"], "left")
    p, r = F.col("hits") / F.col("k"), F.col("hits") / F.col("n_truth")
    return joined.select("k", (2 * p * r / (p + r + eps)).alias("f1"), (F.coalesce("g", F.lit(0.0)) / (F.element_at(ideal, (F.least("n_truth", "k") + 1).cast("int")) + eps)).alias("ndcg")).groupBy("k").agg(F.avg("f1").alias("f1"), F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("users"))


def compare_by_bin(by_user: DataFrame, bins: DataFrame) -> DataFrame:
    """Two recommenders' NDCG by bin of their users (user_id, bin), with the better one."""
    return by_user.join(bins, "user_id").groupBy("bin").agg(F.count(F.lit(1)).alias("users"), F.avg("ndcg_a").alias("ndcg_a"), F.avg("ndcg_b").alias("ndcg_b")).withColumn("better", F.when(F.col("ndcg_a") > F.col("ndcg_b"), "a").when(F.col("ndcg_b") > F.col("ndcg_a"), "b").otherwise("tie"))


def decode(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Original ids of encoded recommendations; scores of 6 digits."""
    return recs.join(users, "uidx").join(items, "tidx").select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")
