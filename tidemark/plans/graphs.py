"""Graph construction, propagation, diffusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph, models, prep, recommend
from tidemark.plans.base import EVENT_SPLIT, ORDER_SPLIT, moment, plan, rounded
from tidemark.plans.prep import MART

DIMS, LAYERS = 4, 2
CATALOGUE = """, users AS (SELECT customer_id AS user_id, row_number() OVER (ORDER BY customer_id) - 1 AS uidx FROM customers), items AS (SELECT product_id AS item_id, row_number() OVER (ORDER BY product_id) - 1 AS tidx FROM products)"""
BOUGHT = f""", bought AS (SELECT o.customer_id AS user_id, i.product_id AS item_id FROM sales o JOIN order_items i ON i.order_id = o.order_id WHERE o.order_time < '{ORDER_SPLIT}')"""
LIFT = (
    BOUGHT
    + """, sizes AS (SELECT segment, count(*) AS members FROM customers WHERE segment IS NOT NULL GROUP BY 1), cells AS (SELECT item_id, segment, count(*) AS n FROM bought JOIN customers ON customer_id = user_id GROUP BY 1, 2),
per_item AS (SELECT item_id, sum(n) AS rows_ FROM cells GROUP BY 1 HAVING sum(n) >= 5),
lift_edges AS (SELECT item_id, segment, round(l, 4) AS lift FROM (SELECT item_id, c.segment, (n * 1.0 / rows_) / (members * 1.0 / (SELECT sum(members) FROM sizes)) AS l FROM cells c JOIN per_item USING (item_id) JOIN sizes s ON s.segment = c.segment) WHERE l > 1.15)"""
)
EDGES = MART + f", edges AS (SELECT DISTINCT user_id AS u, item_id AS t FROM mart WHERE timestamp < '{EVENT_SPLIT}' AND user_id IS NOT NULL)"
NORM = EDGES + """, named AS (SELECT 'u' || u AS src, 'i' || t AS dst, 1.0 AS w FROM edges), both_ways AS (SELECT src, dst, w FROM named UNION ALL SELECT dst, src, w FROM named), deg AS (SELECT src, sum(w) AS d FROM both_ways GROUP BY 1),
norm AS (SELECT b.src, b.dst, b.w / sqrt(x.d * y.d) AS w FROM both_ways b JOIN deg x ON x.src = b.src JOIN deg y ON y.src = b.dst)"""
VECTORS = NORM + """, start AS (SELECT src AS node, x.dim AS dim, CAST(('0x' || substr(md5(src || ':' || x.dim), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS v FROM deg, range(4) x(dim)),
l1 AS (SELECT dst AS node, dim, sum(w * v) AS v FROM norm JOIN start ON node = src GROUP BY 1, 2), l2 AS (SELECT dst AS node, dim, sum(w * v) AS v FROM norm JOIN l1 ON node = src GROUP BY 1, 2),
final AS (SELECT node, dim, sum(v) / 3 AS v FROM (SELECT * FROM start UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2)"""
WALK = EDGES + """, du AS (SELECT u, count(*) AS d FROM edges GROUP BY 1), dt AS (SELECT t, count(*) AS d FROM edges GROUP BY 1),
trans AS (SELECT a.u, b.u AS v, sum(1.0 / du.d / dt.d) AS p FROM edges a JOIN du ON du.u = a.u JOIN edges b ON b.t = a.t JOIN dt ON dt.t = a.t GROUP BY 1, 2),
label AS (SELECT customer_id AS user_id, unnest(CASE WHEN balance >= 5000 THEN [segment, 'WEALTHY'] ELSE [segment] END) AS persona FROM customers WHERE balance >= 1000 AND customer_id IN (SELECT u FROM edges)),
per_user AS (SELECT user_id, count(*) AS n FROM label GROUP BY 1)"""
PREDICT = WALK + """, x AS (SELECT user_id AS v, persona, 1.0 / n AS x FROM label JOIN per_user USING (user_id)), inv AS (SELECT persona, 1 / sum(x) AS inv FROM x GROUP BY 1),
refine AS (SELECT persona, power(inv / (SELECT min(inv) FROM inv), 0.5) AS f FROM inv), near AS (SELECT u, v, p FROM trans WHERE v IN (SELECT user_id FROM label) QUALIFY row_number() OVER (PARTITION BY u ORDER BY round(p, 12) DESC, v) <= 10),
q AS (SELECT u, v, p / sum(p) OVER (PARTITION BY u) AS q FROM near), predicted AS (SELECT u, persona, sum(q * x * f) AS score FROM q JOIN x USING (v) JOIN refine USING (persona) GROUP BY 1, 2)"""
REVERSE = WALK + """, reversed AS (SELECT e.u, l.persona, sum(1.0 / du.d / dt.d / n) AS score FROM label l JOIN per_user USING (user_id) JOIN edges b ON b.u = l.user_id JOIN dt ON dt.t = b.t JOIN edges e ON e.t = b.t JOIN du ON du.u = e.u GROUP BY 1, 2)"""
CORRECTED = REVERSE + """, raw_inv AS (SELECT persona, 1.0 / count(*) AS inv FROM label GROUP BY 1),
corrected AS (SELECT u, persona, score * power(inv / (SELECT min(inv) FROM raw_inv), 0.5) AS score FROM reversed JOIN raw_inv USING (persona))"""
RANKED = CORRECTED + """, ranked AS (SELECT u, persona, row_number() OVER (PARTITION BY u ORDER BY round(score, 12) DESC, persona) AS rank FROM corrected QUALIFY rank <= 5),
truth AS (SELECT user_id AS u, persona FROM label)"""
TRI = (
    LIFT
    + """, tri_named AS (SELECT DISTINCT 'u' || user_id AS src, 'i' || item_id AS dst, 1.0 AS w FROM bought
UNION ALL SELECT 'u' || customer_id, 'p' || segment, 1.0 FROM customers WHERE segment IS NOT NULL UNION ALL SELECT 'i' || item_id, 'p' || segment, lift FROM lift_edges),
tri_both AS (SELECT src, dst, w FROM tri_named UNION ALL SELECT dst, src, w FROM tri_named), tri_deg AS (SELECT src, sum(w) AS d FROM tri_both GROUP BY 1),
tri_norm AS (SELECT b.src, b.dst, b.w / sqrt(x.d * y.d) AS w FROM tri_both b JOIN tri_deg x ON x.src = b.src JOIN tri_deg y ON y.src = b.dst)"""
)
TRI_VECTORS = (
    TRI
    + """, start AS (SELECT src AS node, x.dim AS dim, CAST(('0x' || substr(md5(src || ':' || x.dim), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS v FROM tri_deg, range(4) x(dim)),
l1 AS (SELECT dst AS node, dim, sum(w * v) AS v FROM tri_norm JOIN start ON node = src GROUP BY 1, 2),
l2 AS (SELECT dst AS node, dim, sum(w * v) AS v FROM tri_norm JOIN l1 ON node = src GROUP BY 1, 2),
final AS (SELECT node, dim, sum(v) / 3 AS v FROM (SELECT * FROM start UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2)"""
)


def bought_pairs(t):
    return t.orders.where(F.col("order_time") < moment(ORDER_SPLIT)).join(t.order_items, "order_id").select(F.col("customer_id").alias("user_id"), F.col("product_id").alias("item_id"))


def event_edges(t):
    train, _ = prep.split_by_time(prep.score_mart(t.events, t.sessions), "timestamp", EVENT_SPLIT)
    edges = train.where("user_id IS NOT NULL").select(F.col("user_id").alias("u"), F.col("item_id").alias("t")).distinct()
    return t.keep("event_edges", edges)


def label_set(t):
    """Labels of the users in the graph: their segment, and one more for a high balance; those with a low balance have none."""
    users = t.customers.where("balance >= 1000").join(event_edges(t).select(F.col("u").alias("customer_id")).distinct(), "customer_id", "left_semi")
    return users.select(F.col("customer_id").alias("user_id"), F.explode(F.when(F.col("balance") >= 5000, F.array("segment", F.lit("WEALTHY"))).otherwise(F.array("segment"))).alias("persona"))


def norm_edges(t):
    return t.keep("norm_edges", graph.bipartite_norm(event_edges(t).select("u", F.col("t").alias("i"))))


def vectors_of(t):
    norm = norm_edges(t)
    start = t.keep("start_vectors", graph.initial_vectors(norm.select(F.col("src").alias("node")).distinct(), DIMS))
    return t.keep("vectors", graph.propagate(norm, start, DIMS, LAYERS))


def predictions(t):
    labels = label_set(t)
    ends = labels.select(F.col("user_id").alias("u")).distinct()
    return graph.persona_scores(graph.nearest_by_walk(event_edges(t), ends, 10), labels, 10)


def reverse_predictions(t):
    labels = label_set(t)
    return graph.reverse_prediction(graph.reverse_walk(event_edges(t), labels), labels)


def ranked_personas(t):
    return graph.approximate_personas(reverse_predictions(t))


def tri_parts(t, items=None):
    """Edges of a graph in three parts: (u, i), (u, p) and (i, p, lift); optionally of some items (item_id) only."""
    bought = bought_pairs(t) if items is None else bought_pairs(t).join(items, "item_id", "left_semi")
    pairs = bought.distinct().select(F.col("user_id").alias("u"), F.col("item_id").alias("i"))
    segments = t.customers.where("segment IS NOT NULL").select(F.col("customer_id").alias("u"), F.col("segment").alias("p"))
    lifts = graph.lift_edges(bought, t.customers.select("customer_id", "segment")).select(F.col("item_id").alias("i"), F.col("segment").alias("p"), "lift")
    return pairs, segments, lifts


def tri_vectors_of(t):
    norm = t.keep("tri_norm", graph.weighted_norm(graph.tripartite(*tri_parts(t))))
    start = t.keep("tri_start", graph.initial_vectors(norm.select(F.col("src").alias("node")).distinct(), DIMS))
    return t.keep("tri_vectors", graph.propagate(norm, start, DIMS, LAYERS))


def long_vectors(df):
    return df.select("node", F.posexplode("vec").alias("dim", "v")).select("node", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@plan(CATALOGUE + BOUGHT + ", e AS (SELECT DISTINCT uidx, tidx FROM bought JOIN users USING (user_id) JOIN items USING (item_id)) SELECT u.uidx, coalesce(list(tidx ORDER BY tidx) FILTER (tidx IS NOT NULL), []) AS items FROM users u LEFT JOIN e ON e.uidx = u.uidx GROUP BY 1")
def u2t_adjacency(t):
    users = recommend.encode_ids(t.customers, "customer_id", "uidx").withColumnRenamed("customer_id", "user_id")
    items = recommend.encode_ids(t.products, "product_id", "tidx").withColumnRenamed("product_id", "item_id")
    return graph.adjacency(bought_pairs(t), users, items)


@plan(CATALOGUE + BOUGHT + " SELECT DISTINCT uidx, tidx FROM bought JOIN users USING (user_id) JOIN items USING (item_id)")
def u2t_edges(t):
    return u2t_adjacency(t).select("uidx", F.explode("items").alias("tidx"))


@plan(CATALOGUE + " SELECT uidx, segment FROM customers JOIN users ON user_id = customer_id WHERE segment IS NOT NULL")
def u2p_map(t):
    return t.customers.where("segment IS NOT NULL").join(recommend.encode_ids(t.customers, "customer_id", "uidx"), "customer_id").select("uidx", "segment")


@plan(LIFT + " SELECT item_id, segment, lift FROM lift_edges")
def lift_edges(t):
    return graph.lift_edges(bought_pairs(t), t.customers.select("customer_id", "segment"))


@plan(NORM + " SELECT src, dst, round(w, 6) AS w FROM norm")
def norm_adj_bipartite(t):
    return rounded(norm_edges(t))


@plan(NORM + " SELECT b.src, b.dst, round(b.w / d, 6) AS w FROM both_ways b JOIN deg USING (src)")
def norm_adj_left(t):
    return rounded(graph.bipartite_norm(event_edges(t).select("u", F.col("t").alias("i")), "left"))


@plan(TRI + " SELECT src, dst, round(w, 6) AS w FROM tri_norm")
def norm_adj_tri(t):
    return rounded(graph.weighted_norm(graph.tripartite(*tri_parts(t))))


@plan(TRI_VECTORS + " SELECT node, dim, round(v, 6) AS v FROM final")
def lightgcn_tri_propagate(t):
    return long_vectors(tri_vectors_of(t))


@plan(VECTORS + " SELECT node, dim, round(v, 6) AS v FROM final")
def lightgcn_propagate(t):
    return long_vectors(vectors_of(t))


@plan(
    VECTORS + """, s AS (SELECT a.node AS un, b.node AS tn, sum(a.v * b.v) AS score FROM final a JOIN final b USING (dim) WHERE a.node LIKE 'u%' AND b.node LIKE 'i%' GROUP BY 1, 2),
z AS (SELECT CAST(substr(un, 2) AS BIGINT) AS user_id, CAST(substr(tn, 2) AS BIGINT) AS item_id, score FROM s)
SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM z WHERE NOT EXISTS (SELECT 1 FROM edges WHERE u = user_id AND t = item_id) QUALIFY rank <= 10"""
)
def lightgcn_top_n(t):
    vecs = vectors_of(t)
    side = lambda p, name: vecs.where(F.col("node").startswith(p)).select(F.expr("cast(substr(node, 2) AS bigint)").alias(name), "vec")
    seen = event_edges(t).select(F.col("u").alias("user_id"), F.col("t").alias("item_id"))
    return rounded(graph.score_top_n(side("u", "user_id"), side("i", "item_id"), seen, 10))


@plan(
    TRI_VECTORS
    + """, tri AS (SELECT DISTINCT 'u' || user_id AS u, 'i' || item_id AS pos, 'i' || x.item AS neg
  FROM bought JOIN (SELECT item_id AS k, lead(item_id, 1, (SELECT min(item_id) FROM bought)) OVER (ORDER BY item_id) AS item FROM (SELECT DISTINCT item_id FROM bought)) x ON x.k = item_id),
g AS (SELECT tri.u, pos, neg, sum(a.v * b.v) - sum(a.v * c.v) AS gap, sum(a.v * a.v + b.v * b.v + c.v * c.v) AS sq
  FROM tri JOIN final a ON a.node = tri.u JOIN final b ON b.node = pos AND b.dim = a.dim JOIN final c ON c.node = neg AND c.dim = a.dim GROUP BY 1, 2, 3),
r AS (SELECT sum(ln(1 + exp(-gap))) AS bpr, 0.02 * (sum(sq) + (SELECT sum(v * v) FROM start WHERE node LIKE 'p%')) / 2 AS reg FROM g)
SELECT round(bpr, 4) AS bpr, round(reg, 4) AS reg, round(bpr + reg, 4) AS loss FROM r"""
)
def bpr_loss(t):
    """The unwanted item of a pair is the next one sold, in the order of ids, the first after the last."""
    pairs, vecs = tri_parts(t)[0], tri_vectors_of(t)
    sold = pairs.select(F.col("i").alias("item_id")).distinct()
    index = recommend.encode_ids(sold, "item_id", "tidx")
    n = index.agg(F.count(F.lit(1)).alias("n"))
    after = index.crossJoin(F.broadcast(n)).select(F.col("item_id").alias("i"), F.pmod(F.col("tidx") + 1, F.col("n")).alias("tidx")).join(index.withColumnRenamed("item_id", "j"), "tidx")
    triples = pairs.join(after, "i").select(F.concat(F.lit("u"), "u").alias("u"), F.concat(F.lit("i"), "i").alias("pos"), F.concat(F.lit("i"), "j").alias("neg"))
    personas = t.kept["tri_start"].where(F.col("node").startswith("p"))
    return rounded(graph.bpr_loss(triples, vecs, DIMS, 0.02, personas), 4)


@plan(VECTORS + ", b AS (SELECT node, dim, v, sqrt(sum(v * v) OVER (PARTITION BY node)) AS s FROM final WHERE dim < 2) SELECT node, dim, round(v / s, 5) AS v FROM b")
def truncated_basis(t):
    cut = models.truncate_basis(vectors_of(t), 2, True)
    return cut.select("node", F.posexplode("vec").alias("dim", "v")).select("node", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("v"))


@plan(WALK + " SELECT u, v, round(0.999 * p + 0.001 / (SELECT count(DISTINCT u) FROM edges), 8) AS p FROM trans")
def transition_probs(t):
    edges = event_edges(t)
    n = edges.select("u").distinct().count()
    return rounded(graph.with_teleport(graph.transition(edges), max(1, n)), 8)


@plan(WALK + " SELECT v, round(sum(p) / (SELECT count(DISTINCT u) FROM edges), 8) AS mass FROM trans GROUP BY 1")
def pagerank_step(t):
    edges = event_edges(t)
    return rounded(graph.pagerank_step(even_start(edges), edges), 8)


def even_start(edges):
    users = edges.select(F.col("u").alias("v")).distinct()
    n = users.agg(F.count(F.lit(1)).alias("n"))
    return users.crossJoin(F.broadcast(n)).select("v", (1 / F.col("n")).alias("mass"))


@plan(
    EDGES
    + """, du AS (SELECT u, count(*) AS d FROM edges GROUP BY 1), dt AS (SELECT t, count(*) AS d FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM du),
legs AS (SELECT e.u, e.t, 1.0 / du.d AS a, 1.0 / dt.d AS b FROM edges e JOIN du ON du.u = e.u JOIN dt ON dt.t = e.t),
legs2 AS (SELECT x.u, y.u AS v, sum(x.a * y.b) AS p FROM legs x JOIN legs y ON y.t = x.t GROUP BY 1, 2),
ranks AS (SELECT 0 AS k, u AS v, 1.0 / n AS mass FROM du, n UNION ALL
  SELECT r.k + 1, l.v, 0.999 * sum(r.mass * l.p) + 0.001 / max(n.n) FROM ranks r JOIN legs2 l ON l.u = r.v CROSS JOIN n WHERE r.k < 60 GROUP BY 1, 2)
SELECT v, round(mass, 8) AS mass FROM ranks WHERE k = 60""",
    recursive=True,
)
def pagerank(t):
    edges = event_edges(t)
    return rounded(graph.pagerank(edges, even_start(edges)), 8)


@plan(PREDICT + " SELECT u, persona, round(score, 6) AS score FROM predicted")
def persona_predict(t):
    return rounded(predictions(t))


@plan(REVERSE + " SELECT u, persona, round(score, 8) AS score FROM reversed")
def reverse_walk(t):
    return rounded(graph.reverse_walk(event_edges(t), label_set(t)), 8)


@plan(CORRECTED + " SELECT u, persona, round(score, 8) AS score FROM corrected")
def persona_predict_rev(t):
    return rounded(reverse_predictions(t), 8)


@plan(
    WALK + """, r1 AS (SELECT user_id AS l, persona, 1.0 / n AS r FROM label JOIN per_user USING (user_id) WHERE 1.0 / n >= 0.001 / 3),
r2 AS (SELECT b.t, persona, sum(r / dt.d) AS r FROM r1 JOIN edges b ON b.u = l JOIN dt ON dt.t = b.t GROUP BY 1, 2 HAVING sum(r / dt.d) >= 0.001 / 3) SELECT e.u, persona, round(sum(r / du.d), 8) AS score FROM r2 JOIN edges e USING (t) JOIN du ON du.u = e.u GROUP BY 1, 2"""
)
def reverse_walk_threshold(t):
    return rounded(graph.reverse_walk(event_edges(t), label_set(t), 0.001), 8)


@plan(REVERSE + " SELECT us.u, ps.persona, round(coalesce(score, 1e-12), 8) AS score FROM (SELECT DISTINCT u FROM reversed) us CROSS JOIN (SELECT DISTINCT persona FROM label) ps LEFT JOIN reversed r ON r.u = us.u AND r.persona = ps.persona")
def persona_matrix(t):
    labels = label_set(t)
    scores = graph.reverse_walk(event_edges(t), labels)
    names = labels.select("persona").distinct()
    full = scores.select("u").distinct().crossJoin(F.broadcast(names)).join(scores, ["u", "persona"], "left")
    return rounded(full.select("u", "persona", F.coalesce("score", F.lit(1e-12)).alias("score")), 8)


@plan(EDGES + ", known AS (SELECT DISTINCT t FROM edges JOIN customers ON customer_id = u WHERE balance >= 9000) SELECT c.u, count(e.t) AS unseen FROM (SELECT DISTINCT u FROM edges JOIN customers ON customer_id = u WHERE balance < 9000) c LEFT JOIN edges e ON e.u = c.u AND e.t NOT IN (SELECT t FROM known) GROUP BY 1")
def rank_coverage(t):
    edges, rich = event_edges(t), t.customers.where("balance >= 9000").select(F.col("customer_id").alias("u"))
    others = t.customers.where("balance < 9000").select(F.col("customer_id").alias("u"))
    return graph.coverage_rank(edges.select("u").distinct().join(others, "u", "left_semi"), edges, edges.join(rich, "u", "left_semi").select("t").distinct())


@plan(
    REVERSE + """, tot AS (SELECT u, sum(score) AS s FROM reversed GROUP BY 1), p AS (SELECT u, persona, score / s AS p FROM reversed JOIN tot USING (u)), cur AS (SELECT persona, count(*) * 1.0 / sum(count(*)) OVER () AS q FROM label GROUP BY 1),
h AS (SELECT u, -sum(p * ln(p)) AS h FROM p GROUP BY 1), kl AS (SELECT t.u, sum(q * ln(q / (coalesce(p, 0) + 1e-16))) AS kl FROM tot t CROSS JOIN cur LEFT JOIN p ON p.u = t.u AND p.persona = cur.persona GROUP BY 1) SELECT u, round(h + kl, 5) AS gain FROM h JOIN kl USING (u)"""
)
def rank_entropy_kl(t):
    from tidemark.operators.quality import shares

    labels = label_set(t)
    current = shares(labels, "persona").select("persona", F.col("share").alias("q"))
    return rounded(graph.information_rank(graph.reverse_walk(event_edges(t), labels), current), 5)


@plan(EDGES + " SELECT u, count(*) AS deg FROM edges GROUP BY 1 ORDER BY deg DESC, u LIMIT 5")
def common_users(t):
    return graph.common_users(event_edges(t), 5)


@plan(RANKED + " SELECT u, persona, rank FROM ranked")
def approximate_personas(t):
    return ranked_personas(t)


@plan(
    RANKED + """, m AS (SELECT u, count(*) AS m FROM truth GROUP BY 1), h AS (SELECT r.u, count(*) FILTER (rank <= m) AS at_m, count(*) AS at_k FROM ranked r JOIN truth USING (u, persona) JOIN m ON m.u = r.u GROUP BY 1), g AS (SELECT u, count(*) AS g FROM ranked GROUP BY 1)
SELECT count(*) AS users, round(avg(coalesce(at_m, 0) * 1.0 / m), 6) AS accuracy, round(avg(coalesce(2.0 * at_k / (m + g), 0)), 6) AS f1, round(avg(coalesce(at_k, 0) * 1.0 / m), 6) AS recall FROM m LEFT JOIN h ON h.u = m.u LEFT JOIN g ON g.u = m.u"""
)
def multi_label_eval(t):
    return rounded(graph.multi_label_eval(label_set(t).withColumnRenamed("user_id", "u"), ranked_personas(t)))


@plan(
    RANKED + """, x AS (SELECT coalesce(a.persona, b.persona) AS persona, a.u AS t, b.u AS g FROM truth a FULL JOIN (SELECT r.u, r.persona FROM ranked r WHERE r.u IN (SELECT u FROM truth)) b ON a.u = b.u AND a.persona = b.persona)
SELECT persona, count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (g IS NULL) AS fn, (SELECT count(DISTINCT u) FROM truth) - count(*) AS tn FROM x GROUP BY 1"""
)
def persona_confusion(t):
    return graph.confusion_by_persona(label_set(t).withColumnRenamed("user_id", "u"), ranked_personas(t))


@plan(CATALOGUE + " SELECT tidx, CAST([] AS BIGINT[]) AS segments FROM items")
def empty_mapping(t):
    return graph.empty_mapping(recommend.encode_ids(t.products, "product_id", "tidx"), "tidx", "segments")


@plan(WALK + ", names AS (SELECT persona, row_number() OVER (ORDER BY no NULLS LAST, persona) - 1 AS idx FROM (SELECT persona, CASE persona WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END AS no FROM (SELECT DISTINCT persona FROM label UNION SELECT 'MACHINERY' UNION SELECT 'BUILDING'))) SELECT user_id, idx FROM label JOIN names USING (persona)")
def label_matrix(t):
    from tidemark.operators import personas

    taxonomy = t.spark.createDataFrame([(1, "MACHINERY"), (2, "BUILDING")], "no long, name string")
    labels = label_set(t)
    return personas.label_matrix(labels, personas.persona_index(taxonomy, labels))


@plan(WALK + " SELECT v, round(sum(p), 5) AS mass FROM trans GROUP BY 1 ORDER BY round(sum(p), 12) DESC, v LIMIT 5")
def focused_users(t):
    return rounded(graph.focused_users(event_edges(t), 5), 5)


@plan(
    WALK
    + """, mass AS (SELECT v AS u, round(sum(p), 12) AS x FROM trans GROUP BY 1), scope AS (SELECT DISTINCT u FROM edges JOIN customers ON customer_id = u WHERE balance >= 0),
calm AS (SELECT u FROM scope EXCEPT SELECT u FROM (SELECT u FROM scope JOIN mass USING (u) ORDER BY x DESC, u DESC LIMIT 20)),
kept AS (SELECT u FROM calm EXCEPT SELECT u FROM (SELECT u FROM calm JOIN du USING (u) ORDER BY d DESC, u DESC LIMIT 15)) SELECT u FROM kept"""
)
def prune_scope(t):
    edges = event_edges(t)
    scope = edges.select("u").distinct().join(t.customers.where("balance >= 0").select(F.col("customer_id").alias("u")), "u", "left_semi")
    return graph.prune_scope(edges, scope, 20, 15)


@plan(
    VECTORS + """, b AS (SELECT node, dim AS f, v AS b FROM start), c AS (SELECT f, dim, sum(b * v) AS c FROM b JOIN final USING (node) GROUP BY 1, 2)
SELECT node, dim, round(sum(b * c / (1 + f)), 5) AS v FROM b JOIN c USING (f) GROUP BY 1, 2"""
)
def spectral_filter(t):
    vecs = vectors_of(t)
    out = graph.spectral_filter(t.kept["start_vectors"], vecs, [1 / (1 + f) for f in range(DIMS)], DIMS)
    return out.select("node", F.posexplode("vec").alias("dim", "v")).select("node", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("v"))
