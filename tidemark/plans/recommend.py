"""Recommendation queries: the scored mart is split in time, all that is learned comes from its first part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models, prep, recommend
from tidemark.plans.base import EVENT_SPLIT, plan, rounded
from tidemark.plans.prep import MART

KS = (5, 10, 20)
SPLIT = f"""{MART}, train AS (SELECT * FROM mart WHERE timestamp < '{EVENT_SPLIT}'), test AS (SELECT * FROM mart WHERE timestamp >= '{EVENT_SPLIT}'),
scores AS (SELECT user_id, item_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM train GROUP BY 1, 2),
users AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS uidx FROM (SELECT DISTINCT user_id FROM train WHERE user_id IS NOT NULL)),
items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS tidx FROM (SELECT DISTINCT item_id FROM train WHERE item_id IS NOT NULL)),
truth AS (SELECT DISTINCT user_id, item_id FROM test WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)),
m AS (SELECT uidx AS row, tidx AS col, CAST(score AS DOUBLE) AS val FROM scores JOIN users USING (user_id) JOIN items USING (item_id))"""
POPULAR = """, popular AS (SELECT item_id, sum(score) AS popularity FROM scores GROUP BY 1),
popular_recs AS (SELECT user_id, item_id, CAST(popularity AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, item_id) AS rank
  FROM users CROSS JOIN popular WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.user_id = users.user_id AND s.item_id = popular.item_id) QUALIFY rank <= 20),
list_recs AS (SELECT user_id, item_id, CAST(popularity AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, item_id) AS rank FROM users CROSS JOIN popular QUALIFY rank <= 20)"""
BY_USER = """, ks AS (SELECT unnest([5, 10, 20]) AS k), sizes AS (SELECT user_id, count(*) AS n_truth FROM truth GROUP BY 1),
by_user AS (
  SELECT z.user_id, ks.k, max(n_truth) AS n_truth, count(*) FILTER (t.item_id IS NOT NULL) AS hits, count(*) AS given,
    coalesce(sum(1 / log2(r.rank + 1)) FILTER (t.item_id IS NOT NULL), 0) AS dcg
  FROM sizes z CROSS JOIN ks JOIN list_recs r ON r.user_id = z.user_id AND r.rank <= ks.k LEFT JOIN truth t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY 1, 2
), scored_user AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 101) x(i) WHERE i <= least(n_truth, given)) AS idcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, 101) x(i) WHERE i <= least(n_truth, k)) AS idcg_k FROM by_user)"""


def parts(t):
    """The scored mart before and after the split; the mart is kept, as queries read it several times."""
    return prep.split_by_time(t.keep("mart", prep.score_mart(t.events, t.sessions)), "timestamp", EVENT_SPLIT)


def encoded(t):
    """Scores by user and item of the first part, and dense indices of its users and items."""
    train, _ = parts(t)
    scores = t.keep("scores", prep.user_item_scores(train))
    return scores, t.keep("user_index", recommend.encode_ids(scores, "user_id", "uidx")), t.keep("item_index", recommend.encode_ids(scores, "item_id", "tidx"))


def matrix(t):
    return t.keep("matrix", recommend.coordinates(*encoded(t)))


def list_recs(t, n=20):
    """The n most popular items for every user, seen or not: what the metrics are computed on."""
    scores, users, _ = encoded(t)
    popular = recommend.top_items(recommend.popularity(scores), n)
    offered = users.crossJoin(F.broadcast(popular))
    return recommend.top_n(offered.select("user_id", "item_id", F.col("popularity").cast("double").alias("score")), n)


def truth_of(t):
    train, test = parts(t)
    return recommend.ground_truth(test, train)


@plan(SPLIT + " SELECT user_id, uidx FROM users")
def user_encoding(t):
    return encoded(t)[1]


@plan(SPLIT + " SELECT row, col, val FROM m")
def score_matrix(t):
    return matrix(t)


@plan(SPLIT + ", n AS (SELECT count(DISTINCT row) AS n FROM m), d AS (SELECT col, count(*) AS df FROM m GROUP BY 1) SELECT row, col, round(sqrt(val) * (ln(n) - ln(1 + df)), 6) AS val FROM m JOIN d USING (col), n")
def tfidf_weight(t):
    return rounded(recommend.tfidf_weight(matrix(t)))


@plan(SPLIT + ", l AS (SELECT row, sum(val) AS len FROM m GROUP BY 1), a AS (SELECT avg(len) AS avg_len, count(*) AS n FROM l), d AS (SELECT col, count(*) AS df FROM m GROUP BY 1) SELECT row, col, round(val * 2.2 / (1.2 * (0.25 + 0.75 * len / avg_len) + val) * (ln(n) - ln(1 + df)), 6) AS val FROM m JOIN l USING (row) JOIN d USING (col), a")
def bm25_weight(t):
    return rounded(recommend.bm25_weight(matrix(t)))


@plan(SPLIT + POPULAR + " SELECT item_id, CAST(popularity AS BIGINT) AS popularity FROM popular")
def item_popularity(t):
    return recommend.popularity(encoded(t)[0])


@plan(SPLIT + POPULAR + " SELECT user_id, item_id, score, rank FROM popular_recs")
def popular_top_n(t):
    scores, users, _ = encoded(t)
    return recommend.popular_top_n(users, scores, recommend.popularity(scores), 20)


@plan(SPLIT + " SELECT user_id, item_id FROM truth")
def ground_truth(t):
    return truth_of(t)


@plan(
    SPLIT + POPULAR + BY_USER + """, e AS (SELECT k, round(avg(CAST(hits > 0 AS DOUBLE)), 4) AS hr, round(avg(hits * 1.0 / n_truth), 4) AS recall, round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 4) AS ndcg, count(*) AS eval_users FROM scored_user GROUP BY 1)
SELECT CAST(k AS BIGINT) AS k, hr, recall, ndcg, eval_users, (SELECT count(*) FROM sizes) - eval_users AS skipped FROM e"""
)
def hr_recall_ndcg(t):
    return recommend.evaluate_at(list_recs(t), truth_of(t), KS)


@plan(SPLIT + POPULAR + BY_USER + " SELECT CAST(k AS BIGINT) AS k, round(avg(2 * (hits * 1.0 / k) * (hits * 1.0 / n_truth) / (hits * 1.0 / k + hits * 1.0 / n_truth + 1e-10)), 6) AS f1, round(avg(dcg / (idcg_k + 1e-10)), 6) AS ndcg, count(*) AS users FROM scored_user GROUP BY 1")
def train_f1_ndcg(t):
    return rounded(recommend.train_f1_ndcg(list_recs(t), truth_of(t), KS))


@plan(
    SPLIT + POPULAR + BY_USER + """, u AS (SELECT user_id, max(coalesce(dcg / nullif(idcg, 0), 0)) FILTER (k = 5) AS ndcg_a, max(coalesce(dcg / nullif(idcg, 0), 0)) FILTER (k = 20) AS ndcg_b FROM scored_user GROUP BY 1),
c AS (SELECT user_id, CAST(count(item_id) // 40 AS BIGINT) AS bin FROM train GROUP BY 1), z AS (SELECT bin, count(*) AS users, avg(ndcg_a) AS a, avg(ndcg_b) AS b FROM u JOIN c USING (user_id) GROUP BY 1)
SELECT bin, users, round(a, 6) AS ndcg_a, round(b, 6) AS ndcg_b, CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' ELSE 'tie' END AS better FROM z"""
)
def binned_compare(t):
    by = recommend.ranking_by_user(list_recs(t), truth_of(t), KS).groupBy("user_id").agg(F.max(F.when(F.col("k") == 5, F.col("ndcg"))).alias("ndcg_a"), F.max(F.when(F.col("k") == 20, F.col("ndcg"))).alias("ndcg_b"))
    bins = parts(t)[0].groupBy("user_id").agg(F.floor(F.count("item_id") / 40).cast("long").alias("bin"))
    return rounded(recommend.compare_by_bin(by, bins))


@plan(SPLIT + POPULAR + " SELECT user_id, item_id, round(score, 6) AS score, rank FROM list_recs")
def decode_recommendations(t):
    _, users, items = encoded(t)
    coded = list_recs(t).join(users, "user_id").join(items, "item_id").select("uidx", "tidx", "score", "rank")
    return recommend.decode(coded, users, items)


@plan(
    SPLIT + POPULAR + """, l AS (SELECT user_id, list(item_id ORDER BY rank) AS recommended FROM list_recs GROUP BY 1), w AS (SELECT user_id, list(item_id ORDER BY item_id) AS truth FROM truth GROUP BY 1)
SELECT w.user_id, truth, coalesce(recommended, []) AS recommended FROM w LEFT JOIN l ON l.user_id = w.user_id"""
)
def evaluation_dump(t):
    return recommend.evaluation_dump(list_recs(t), truth_of(t))


@plan(
    SPLIT + POPULAR + BY_USER.replace("FROM truth", "FROM known").replace("JOIN truth t", "JOIN known t").replace(", ks AS", ", known AS (SELECT DISTINCT user_id, item_id FROM train WHERE user_id IS NOT NULL), ks AS", 1)
    + " SELECT CAST(k AS BIGINT) AS k, round(avg(2 * (hits * 1.0 / k) * (hits * 1.0 / n_truth) / (hits * 1.0 / k + hits * 1.0 / n_truth + 1e-10)), 6) AS f1, round(avg(dcg / (idcg_k + 1e-10)), 6) AS ndcg, count(*) AS users FROM scored_user GROUP BY 1"
)
def fit_on_train_items(t):
    """The training items themselves as the truth, with nothing masked."""
    known = encoded(t)[0].where("user_id IS NOT NULL").select("user_id", "item_id").distinct()
    return rounded(recommend.train_f1_ndcg(list_recs(t), known, KS))


@plan(
    SPLIT + """, items_n AS (SELECT count(*) AS n FROM items), unseen AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY tidx) - 1 AS nr, count(*) OVER (PARTITION BY user_id) AS open
  FROM users CROSS JOIN items WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.user_id = users.user_id AND s.item_id = items.item_id)),
drawn AS (SELECT s.user_id, s.item_id, d AS draw, CAST(('0x' || substr(md5(s.user_id || ':' || s.item_id || ':' || d || ':42'), 1, 12)) AS BIGINT) AS h FROM scores s, range(1, 4) x(d))
SELECT drawn.user_id, drawn.item_id, CAST(draw AS INTEGER) AS draw, u.item_id AS negative FROM drawn JOIN unseen u ON u.user_id = drawn.user_id AND u.nr = h % u.open"""
)
def negative_samples(t):
    scores, _, items = encoded(t)
    return models.sample_negatives(scores.select("user_id", "item_id"), items, 3)
