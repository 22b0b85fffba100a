"""One query for each operator of this subpackage, over its whole table, and the SQL to hold some of them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, langid, mixing, mpeg_audio, simhash, token_counts, toxicity, url_filter, warc
from tidemark.llm.common import in_fold

TOXIC_AT = 0.3
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), toxicity.score_column(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.extract_column(F.col("html")).alias("x"))
    return pages.select("page_id", "url", "x.text", "x.n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = docs.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), langid.predict_column(model, F.col("text"), spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", mpeg_audio.digest_column(F.col("text")).alias("m"))
    return stored.select("doc_id", "m.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    counted = table(spark, sf_dir, "documents").select("doc_id", token_counts.count_column(F.col("text"), spark, vocabulary).alias("c"))
    return counted.select("doc_id", "c.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).taken()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_index(spark, index).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    words, hit, items = F.col("__tm_scan.n_words"), F.col("__tm_hit"), F.col("__tm_scan.items")
    return found.select("doc_id", words.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), decontaminate.items_digest(items).alias("items_sha256"), decontaminate.contaminated(hit, words).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_html_extract, op3_language_id, op4_mpeg_audio, op5_simhash, op6_token_counts, op7_url_filter, op8_mixing, op9_warc, op10_decontaminate)}


def _spread_sql(name: str, column: str, source: str, target: str, damping: float = 0.85, tolerance: float = 1e-3) -> str:
    """CTEs for one propagation over all its rounds; the last is called ``name``."""
    start = f"SELECT 0 AS n, host, {1 - damping} * {column} AS moved FROM seeds WHERE {column} > 0"
    step = f"SELECT n + 1, e.{target}, sum({damping} * moved * share) FROM {name}_moves x JOIN links e ON e.{source} = x.host WHERE n < {url_filter.max_rounds(damping, tolerance)} GROUP BY 1, 2"
    return f"{name}_moves AS ({start} UNION ALL {step}), {name} AS (SELECT host, sum(moved) AS s FROM {name}_moves GROUP BY 1)"


def _url_filter_sql() -> str:
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = url_filter.rule_order(RULES)
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    cases = lambda value: "CASE " + " ".join(f"WHEN {f} THEN '{value(r)}'" for f, r in zip(fits, rules, strict=True)) + " END"
    link = url_filter.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE own AS (
  SELECT page_id, html, coalesce({host.format("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT page_id, html, host, path, {cases(lambda r: r[1] + r[2])} AS rule, {cases(lambda r: r[0])} AS action FROM own
), seeds AS (
  SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM ruled WHERE host <> '' GROUP BY 1
), found AS (
  SELECT host AS src, 'x://' || regexp_replace(unnest(regexp_extract_all(html, '{link}', 1)), '(?i)^(?:[a-z][a-z0-9+.-]*:)?//', '') AS u FROM ruled
), edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, {host.format("u")} AS dst FROM found) WHERE src <> '' AND dst <> '' AND src <> dst
), links AS (
  SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM edges
), {_spread_sql("good", "trust", "src", "dst")}, {_spread_sql("bad", "distrust", "dst", "src")}, blocked AS (
  SELECT bad.host FROM bad LEFT JOIN good USING (host) WHERE bad.s > coalesce(good.s, 0) AND bad.s > 0.5 * {1 - 0.85}
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict FROM ruled
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force or round trips."""
    return {
        "op7_url_filter": _url_filter_sql(),
        "op9_warc": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), bits AS (
  SELECT page_id, n, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j:
      ((strpos('0123456789abcdef', substr(h, CAST((i * 5 + j) // 4 AS INTEGER) + 1, 1)) - 1) >> CAST(3 - (i * 5 + j) % 4 AS INTEGER)) % 2 * CAST(power(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS digest
  FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM bits
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
        "op10_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), pos AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n
), found AS (
  SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.k = array_to_string(pos.w[pos.i : pos.i + pos.n - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    }
