"""Text-layer queries, over documents, benchmark items, conversations and inline lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import personas, quality
from tidemark.plans.base import plan
from tidemark.plans.features import FEATURES, SEGMENT, customer_table, segment_table
from tidemark.plans.quality import TOP_TEXT, with_segment

REPLIES = [
    ("a", 1, "1. **Bargain Hunter** - Buys on discount\n2. Night Owl: Shops after midnight\nnot a line"),
    ("b", 2, "1. Bargain Seeker - Looks for discount offers\n2. Gadget Fan - Buys new devices first\n3. **Home Maker**: Buys for the home"),
    ("c", 3, "no list at all"),
    ("d", 4, None),
]
MODEL_REPLIES = [
    (1, 'Sure! {"personas": ["Bargain Hunter", "Unknown"]} done'),
    (2, "{'personas': ['Night Owl']}"),
    (3, '{"personas": ["Unrepresentable"]}'),
    (4, "nothing to parse"),
    (5, None),
    (6, '{"personas": ["Gadget Fan", "Bargain Hunter"]}'),
]
TAXONOMY = ["Bargain Hunter", "Night Owl", "Gadget Fan", "Home Maker"]
GROUPS = {"price": "bargain|discount|saver", "home": "home|family", "tech": "gadget|device", "time": "night|weekend"}
KEYWORDS = ["discount", "midnight", "luxury", "home"]


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SETS = "WITH sets AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', {i}, {sql_text(x)})" for d, i, x in REPLIES) + ") v(dataset, id, reply)), cleaned AS (SELECT dataset, trim(regexp_replace(reply, '\\*+', '', 'g')) AS reply FROM sets), lines AS (SELECT dataset, unnest(string_split(reply, chr(10))) AS l FROM cleaned), parsed AS (SELECT dataset, CAST(regexp_extract(l, '^\\s*(\\d+)\\.', 1) AS BIGINT) AS no, regexp_extract(l, '^\\s*\\d+\\.\\s*(.+?)\\s*(?:\\s-\\s|:)\\s*(.+?)\\s*$', 1) AS name, regexp_extract(l, '^\\s*\\d+\\.\\s*(.+?)\\s*(?:\\s-\\s|:)\\s*(.+?)\\s*$', 2) AS definition FROM lines WHERE regexp_matches(l, '^\\s*\\d+\\.\\s*(.+?)\\s*(?:\\s-\\s|:)\\s*(.+?)\\s*$'))"
MATCHES = "CASE " + " ".join(f"WHEN regexp_matches(lower(name || ' ' || definition), '{p}') THEN '{n}'" for n, p in GROUPS.items()) + " ELSE 'Other' END"
TOK = "list_distinct(list_filter(regexp_extract_all(lower(definition || ' ' || name), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('for', 'the', 'and')))"


def persona_rows(t):
    rows = t.spark.createDataFrame(REPLIES, "dataset string, id int, reply string")
    return rows.select("dataset", F.explode(text.numbered_items("reply")).alias("x")).select("dataset", "x.*")


def persona_tokens(t):
    return persona_rows(t).withColumn("tokens", text.tokens(F.concat_ws(" ", "definition", "name"), ["for", "the", "and"]))


def model_replies(t):
    parsed = t.spark.createDataFrame(MODEL_REPLIES, "id long, reply string").withColumn("labels", text.parse_reply("reply", "personas array<string>")["personas"])
    return parsed.withColumn("valid", text.valid_labels("labels", F.array(*[F.lit(x) for x in TAXONOMY])))


@plan(f"{SETS} SELECT * FROM parsed", views=False)
def parse_numbered_list(t):
    return persona_rows(t)


@plan(f"{SETS} SELECT dataset, count(*) AS rows, count(DISTINCT name) AS names, round(avg(length(definition)), 6) AS mean_length FROM parsed GROUP BY 1", views=False)
def persona_set_summary(t):
    return personas.set_summary(persona_rows(t)).withColumn("mean_length", F.round("mean_length", 6))


@plan(f"{SETS} SELECT name, {MATCHES} AS macro_group FROM parsed", views=False)
def macro_group(t):
    return persona_rows(t).select("name", text.first_category(F.concat_ws(" ", "name", "definition"), GROUPS).alias("macro_group"))


@plan(f"{SETS} SELECT name, list_filter([{', '.join(f'''CASE WHEN regexp_matches(lower(name || ' ' || definition), '{p}') THEN '{n}' END''' for n, p in GROUPS.items())}], lambda x: x IS NOT NULL) AS groups FROM parsed", views=False)
def all_groups(t):
    return persona_rows(t).select("name", text.all_categories(F.concat_ws(" ", "name", "definition"), GROUPS).alias("groups"))


@plan(f"{SETS}, g AS (SELECT dataset, {MATCHES} AS g FROM parsed) SELECT g, count(*) FILTER (dataset = 'a') AS a, count(*) FILTER (dataset = 'b') AS b FROM g GROUP BY 1", views=False)
def group_pivot(t):
    groups = persona_rows(t).select("dataset", text.first_category(F.concat_ws(" ", "name", "definition"), GROUPS).alias("g"))
    return groups.groupBy("g").pivot("dataset", ["a", "b"]).count().na.fill(0)


@plan(
    f"""{SETS}, k AS (SELECT dataset, name, {TOK} AS tk FROM parsed), p AS (SELECT x.name AS a, y.name AS b, len(list_intersect(x.tk, y.tk)) * 1.0 / len(list_distinct(list_concat(x.tk, y.tk))) AS s FROM k x JOIN k y ON x.dataset = 'a' AND y.dataset = 'b' WHERE len(list_intersect(x.tk, y.tk)) > 0),
best AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1) SELECT k.name AS a, best.b, round(coalesce(s, 0), 6) AS similarity FROM k LEFT JOIN best ON best.a = k.name WHERE k.dataset = 'a'""",
    views=False,
)
def jaccard_best_match(t):
    sets = persona_tokens(t)
    found = personas.best_matches(sets.where("dataset = 'a'"), sets.where("dataset = 'b'"))
    return found.withColumn("similarity", F.round("similarity", 6))


@plan(
    f"""{SETS} SELECT name, length(definition) < 18 AS short, regexp_matches(lower(definition), 'discount') AS price, concat_ws('|', CASE WHEN length(definition) < 18 THEN 'short' END, CASE WHEN regexp_matches(lower(definition), 'discount') THEN 'price' END, CASE WHEN count(*) OVER (PARTITION BY lower(split_part(name, ' ', 1))) > 1 THEN 'shared_word' END) AS flags FROM parsed""",
    views=False,
)
def review_flags(t):
    from pyspark.sql import Window

    shared = F.count(F.lit(1)).over(Window.partitionBy(F.lower(F.split("name", " ")[0]))) > 1
    rows = persona_rows(t).withColumns({"short": F.length("definition") < 18, "price": F.lower("definition").rlike("discount"), "__shared": shared})
    return rows.select("name", "short", "price", F.array_join(F.array_compact(F.array(F.when(F.col("short"), "short"), F.when(F.col("price"), "price"), F.when(F.col("__shared"), "shared_word"))), "|").alias("flags"))


@plan(f"{SETS} SELECT name, list_filter({KEYWORDS}, lambda k: contains(lower(name || ' ' || definition), k)) AS warnings FROM parsed", views=False)
def keyword_check(t):
    return persona_rows(t).select("name", text.keyword_warnings(F.concat_ws(" ", "name", "definition"), KEYWORDS).alias("warnings"))


@plan("SELECT * FROM (VALUES (1, ['Bargain Hunter'], 'ok'), (2, ['Night Owl'], 'ok'), (3, ['Unrepresentable'], 'unrepresentable'), (4, NULL, 'unparseable'), (5, NULL, 'query_failed'), (6, ['Gadget Fan', 'Bargain Hunter'], 'ok')) v(id, valid, status)", views=False)
def label_validate(t):
    return personas.label_status(model_replies(t), "reply", "labels", "valid").select(F.col("id").cast("int").alias("id"), "valid", "status")


@plan(
    """, b AS (SELECT o.customer_id AS user_id, p.product_name AS item_name, CAST(sum(quantity) AS BIGINT) AS q FROM sales o JOIN order_items i ON i.order_id = o.order_id JOIN products p ON p.product_id = i.product_id GROUP BY 1, 2)
SELECT user_id, string_agg(item_name || ' x' || q, ', ' ORDER BY item_name, q) AS purchases FROM b GROUP BY 1"""
)
def describe_user(t):
    bought = t.orders.join(t.order_items, "order_id").join(t.products, "product_id")
    return personas.describe_purchases(bought.select(F.col("customer_id").alias("user_id"), F.col("product_name").alias("item_name"), "quantity"))


@plan(
    FEATURES + """, b AS (SELECT o.customer_id, p.product_name AS item_name, CAST(sum(quantity) AS BIGINT) AS q FROM sales o JOIN order_items i ON i.order_id = o.order_id JOIN products p ON p.product_id = i.product_id GROUP BY 1, 2), d AS (SELECT customer_id, string_agg(item_name || ' x' || q, ', ' ORDER BY item_name, q) AS purchases FROM b GROUP BY 1)
SELECT customer_id, 'Purchases: ' || coalesce(purchases, 'N/A') || chr(10) || 'Sessions: ' || n_sessions || chr(10) || 'Favourite category: ' || coalesce(top_viewed_category, 'N/A') || chr(10) || 'Days since last order: ' || coalesce(CAST(order_recency_days AS VARCHAR), 'N/A') AS description FROM features LEFT JOIN d USING (customer_id)"""
)
def user_prompt_text(t):
    bought = t.orders.join(t.order_items, "order_id").join(t.products, "product_id")
    return personas.describe_users(customer_table(t), bought.select(F.col("customer_id").alias("user_id"), F.col("product_name").alias("item_name"), "quantity"))


@plan(
    FEATURES + TOP_TEXT.replace("SELECT segment, string_agg", ", top_text AS (SELECT segment, string_agg", 1).replace("GROUP BY 1", "GROUP BY 1")
    + """), prof AS (SELECT segment, count(*) AS customers, avg(total_spend) AS m, median(total_spend) AS md, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM features JOIN customers USING (customer_id) GROUP BY 1)
SELECT segment, 'Segment: ' || segment || chr(10) || 'Customers: ' || customers || chr(10) || 'Share: ' || printf('%.1f%%', round(share * 100, 1)) || chr(10) || 'Mean spend: ' || printf('%.2f', round(m, 2)) || chr(10) || 'Median spend: ' || printf('%.1f', round(md, 1)) || chr(10) || 'Top categories: ' || top_categories AS summary FROM prof JOIN top_text USING (segment)"""
)
def summary_text(t):
    table = with_segment(t)
    return personas.segment_prompt_text(quality.profile(table, "segment", ["total_spend"]).join(quality.top_category_text(table, "segment", "top_purchased_category"), "segment", "left"))


def _line_sql(said: str, column: str, how: str) -> str:
    factor, digits, sign = {"number": (1, 2, ""), "one_digit": (1, 1, ""), "percent": (100, 1, "%%")}[how]
    value = f"printf('%.{digits}f{sign}', floor(avg(CAST({column} AS DOUBLE)) * {factor * 10**digits} + 0.5 + 1e-7) / {10**digits})"
    return f"'- {said}: ' || coalesce({value}, 'none')"


def _top_sql(name: str, column: str) -> str:
    return f""", {name}_n AS (SELECT segment, {column} AS c, count(*) AS n FROM seg WHERE {column} IS NOT NULL GROUP BY 1, 2),
{name}_r AS (SELECT segment, c, n * 100.0 / sum(n) OVER (PARTITION BY segment) AS s, row_number() OVER (PARTITION BY segment ORDER BY n DESC, c) AS at_ FROM {name}_n),
{name} AS (SELECT segment, string_agg(printf('%s: %.1f%%', c, round(s, 1)), '; ' ORDER BY at_) AS t FROM {name}_r WHERE at_ <= 3 GROUP BY 1)"""


@plan(
    SEGMENT
    + """, seg AS (SELECT f.*, c.segment, CAST(n_orders > 0 AS DOUBLE) AS is_buyer, n_purchase * 1.0 / nullif(n_sessions, 0) AS purchase_per_session FROM segment_features f JOIN customers c USING (customer_id) WHERE c.segment IS NOT NULL)"""
    + _top_sql("viewed_most", "top_viewed_category") + _top_sql("bought_most", "top_purchased_category")
    + ", lines AS (SELECT segment, 'Segment ' || segment || ' in figures' || chr(10) || '- Customers: ' || format('{:,}', count(*)) || ' (' || printf('%.1f%%', floor(count(*) * 1000.0 / (SELECT count(*) FROM seg) + 0.5 + 1e-7) / 10) || ' of all)' || chr(10) || "
    + " || chr(10) || ".join(_line_sql(*x) for x in personas.SUMMARY_LINES)
    + " AS l FROM seg GROUP BY 1) SELECT lines.segment, l || chr(10) || '- Categories viewed most: ' || coalesce(v.t, 'none') || chr(10) || '- Categories bought most: ' || coalesce(b.t, 'none') AS summary FROM lines LEFT JOIN viewed_most v ON v.segment = lines.segment LEFT JOIN bought_most b ON b.segment = lines.segment"
)
def segment_summary(t):
    table = segment_table(t).join(t.customers.select("customer_id", "segment"), "customer_id")
    return personas.segment_summary(personas.segment_statistics(table))


CATALOGUE_GROUPS = {"metal": "bolt|gear|ring", "warm": "red|hot|gold", "small": "small|tiny|mini"}
CATALOGUE_MATCH = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{p}') THEN '{n}'" for n, p in CATALOGUE_GROUPS.items()) + " ELSE 'Other' END"


@plan("SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS no, p_name AS name, lower(p_type) || ' ware of size ' || p_size AS definition FROM part", views=False)
def parse_catalogue_lists(t):
    """Numbered lists of each brand's parts, written as text in two ways, and parsed again."""
    from pyspark.sql import Window

    numbered = t.raw("part").withColumn("no", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    sep = F.when(F.col("no") % 2 == 0, F.lit(" - ")).otherwise(F.lit(": "))
    line = F.concat(F.col("no").cast("string"), F.lit(". **"), F.col("p_name"), F.lit("**"), sep, F.lower("p_type"), F.lit(" ware of size "), F.col("p_size").cast("string"))
    written = numbered.select("p_brand", F.struct("no", line.alias("line")).alias("x")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("line"), "\n").alias("reply"))
    return written.select(F.col("p_brand").alias("brand"), F.explode(text.numbered_items("reply")).alias("x")).select("brand", "x.*")


@plan(f"SELECT p_type AS category, {CATALOGUE_MATCH} AS macro_group, count(*) AS n FROM part GROUP BY 1, 2", views=False)
def catalogue_groups(t):
    return t.raw("part").groupBy(F.col("p_type").alias("category"), text.first_category("p_name", CATALOGUE_GROUPS).alias("macro_group")).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT item_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3))) AS BIGINT) AS tokens, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM benchmark", views=False)
def tokenise_items(t):
    return t.raw("benchmark").select("item_id", F.size(text.tokens("text")).cast("long").alias("tokens"), text.normalise_dashes("text").alias("clean"))


@plan("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY 1", views=False)
def conversation_turns(t):
    return t.raw("conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@plan("""WITH p AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('split:' || user_id || ':' || item_id), item_id) AS at_, count(*) OVER (PARTITION BY user_id) AS n FROM p) SELECT user_id, item_id, CASE WHEN at_ <= greatest(floor(n * 0.8), 1) THEN 'train' ELSE 'test' END AS part FROM r""", views=False)
def split_items(t):
    pairs = t.orders.join(t.order_items, "order_id").select(F.col("customer_id").alias("user_id"), F.col("product_id").alias("item_id")).distinct()
    return personas.split_items(pairs)


@plan(
    """, pers AS (SELECT * FROM (VALUES ('BUILDING', 'Builders', ['spend'], 'OK'), ('MACHINERY', NULL, NULL, 'NAMING_FAILED')) v(segment, segment_name, evidence, status))
SELECT customer_id, segment, segment_name, CASE WHEN pers.segment IS NOT NULL THEN CASE WHEN evidence IS NULL THEN '[]' ELSE '["spend"]' END END AS evidence, status FROM customers LEFT JOIN pers USING (segment)"""
)
def merge_personas(t):
    rows = t.spark.createDataFrame([("BUILDING", "Builders", ["spend"], "OK"), ("MACHINERY", None, None, "NAMING_FAILED")], "segment string, segment_name string, evidence array<string>, status string")
    return personas.merge_personas(t.customers.select("customer_id", "segment"), rows.withColumn("cautions", F.lit(None).cast("array<string>"))).select("customer_id", "segment", "segment_name", "evidence", "status")


@plan()
def segment_naming(t):
    """Prompts, calls of an offline client on the executors, parsing and validation."""
    prompts = segment_summary(t).select("segment", F.format_string(personas.NAMING_PROMPT, "summary").alias("prompt"))
    return personas.naming_status(personas.fan_out(prompts, personas.offline_client, "segment", "prompt", retries=2))


@plan(f"{SETS} SELECT dataset, string_agg(no || '. ' || name || ' - ' || definition, chr(10) ORDER BY no) AS text FROM parsed GROUP BY 1", views=False)
def format_persona_sets(t):
    return personas.format_sets(persona_rows(t))
