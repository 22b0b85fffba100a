"""Persona text layer: descriptions, prompts, fan-out of model calls, taxonomies and their comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import ratio
from tidemark.functions.text import jaccard, number, parse_reply, percent, schema_errors, text_or_none

LABEL_PROMPT = "Choose one to five of these personas for the customer below. Reply with a JSON object {\"personas\": [names]}; if none fits, use \"Unrepresentable\".\nPersonas:\n%s\nCustomer:\n%s"
NAMING_PROMPT = "Name this customer segment. Reply with a JSON object with segment_name, description, evidence (list) and cautions (list). Use only the figures given.\n%s"
ROUND_PROMPTS = (
    "From these customers' purchases, write numbered personas as `N. Name - Definition`.\n%s",
    "Merge these persona lists into one numbered list without repeats.\n%s",
    "Reduce this list to the final numbered taxonomy.\n%s",
)
NAMING_SCHEMA = "segment_name string, description string, evidence array<string>, cautions array<string>"
REPLY = T.StructType([T.StructField("key", T.StringType()), T.StructField("status", T.StringType()), T.StructField("reply", T.StringType()), T.StructField("attempts", T.LongType())])
Client = Callable[[str], str]


def describe_purchases(purchases: DataFrame) -> DataFrame:
    """By user, the bought items with their quantities in words, by item name."""
    lines = purchases.groupBy("user_id", "item_name").agg(F.sum("quantity").alias("q"))
    parts = F.array_sort(F.collect_list(F.struct("item_name", "q")))
    return lines.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["item_name"], F.lit(" x"), p["q"].cast("string"))), ", ").alias("purchases"))


def describe_users(features: DataFrame, purchases: DataFrame) -> DataFrame:
    """Description of each user for a prompt: purchases, then behaviour, N/A where nothing is known."""
    known = features.join(describe_purchases(purchases).withColumnRenamed("user_id", "customer_id"), "customer_id", "left")
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    return known.select("customer_id", F.concat_ws("\n", F.concat(F.lit("Purchases: "), na(F.col("purchases"))), F.concat(F.lit("Sessions: "), F.col("n_sessions").cast("string")), F.concat(F.lit("Favourite category: "), na(F.col("top_viewed_category"))), F.concat(F.lit("Days since last order: "), na(F.col("order_recency_days").cast("string")))).alias("description"))


def segment_prompt_text(profile: DataFrame) -> DataFrame:
    """Short summary of a segment in lines."""
    lines = (
        F.concat(F.lit("Segment: "), text_or_none("segment")),
        F.concat(F.lit("Customers: "), text_or_none("customers")),
        F.concat(F.lit("Share: "), percent("share")),
        F.concat(F.lit("Mean spend: "), number("total_spend_mean")),
        F.concat(F.lit("Median spend: "), number("total_spend_median", 1)),
        F.concat(F.lit("Top categories: "), text_or_none("top_categories")),
    )
    return profile.select("segment", F.concat_ws("\n", *lines).alias("summary"))


#: Lines of a segment's summary after its size: what is said, the measure, and how it is written.
SUMMARY_LINES = (
    ("Page views a customer", "n_page_view", "number"),
    ("Cart events a customer", "n_add_to_cart", "number"),
    ("Cart events per page view", "cart_per_view", "percent"),
    ("Customers with an order", "is_buyer", "percent"),
    ("Orders a customer", "n_orders", "number"),
    ("Purchases per session", "purchase_per_session", "number"),
    ("Spend on a log scale", "log_total_spend", "number"),
    ("Days since the last session", "session_recency_days", "one_digit"),
    ("Days since the last order", "order_recency_days", "one_digit"),
    ("Categories bought", "purchase_diversity", "number"),
    ("Share of the category viewed most", "dominant_view_ratio", "percent"),
    ("Share of the category bought most", "dominant_purchase_ratio", "percent"),
    ("Same category viewed and bought most", "category_match", "percent"),
)


def segment_statistics(table: DataFrame, group: str = "segment") -> DataFrame:
    """By segment, its size and share, means of what the summary says, and its top categories viewed and bought."""
    from tidemark.operators.quality import top_category_text

    rows = table.where(F.col(group).isNotNull()).withColumns({"is_buyer": (F.col("n_orders") > 0).cast("double"), "purchase_per_session": ratio("n_purchase", "n_sessions")})
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    means = rows.groupBy(group).agg(F.count(F.lit(1)).alias("customers"), *[F.avg(F.col(c).cast("double")).alias(c) for _, c, _ in SUMMARY_LINES])
    viewed = top_category_text(table, group, "top_viewed_category").withColumnRenamed("top_categories", "top_viewed")
    bought = top_category_text(table, group, "top_purchased_category").withColumnRenamed("top_categories", "top_bought")
    return means.crossJoin(F.broadcast(total)).withColumn("share", ratio("customers", "__total")).drop("__total").join(viewed, group, "left").join(bought, group, "left")


def segment_summary(statistics: DataFrame, group: str = "segment") -> DataFrame:
    """The whole summary of each segment for the naming prompt, in 17 lines; ``none`` where nothing is known."""
    def half_up(c: str, factor: float, digits: int, sign: str = "") -> Column:
        """Rounded in whole steps, so that halves don't depend on how a sum was added up."""
        value = F.floor(F.col(c) * factor * 10**digits + 0.5 + 1e-7) / 10**digits
        return F.coalesce(F.concat(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))), F.lit(sign)), F.lit("none"))

    written = {"number": lambda c: half_up(c, 1, 2), "one_digit": lambda c: half_up(c, 1, 1), "percent": lambda c: half_up(c, 100, 1, "%")}
    lines = [
        F.concat(F.lit("Segment "), text_or_none(group), F.lit(" in figures")),
        F.concat(F.lit("- Customers: "), F.format_number("customers", 0), F.lit(" ("), written["percent"]("share"), F.lit(" of all)")),
        *[F.concat(F.lit(f"- {said}: "), written[how](c)) for said, c, how in SUMMARY_LINES],
        F.concat(F.lit("- Categories viewed most: "), text_or_none("top_viewed")),
        F.concat(F.lit("- Categories bought most: "), text_or_none("top_bought")),
    ]
    return statistics.select(group, F.concat_ws("\n", *lines).alias("summary"))


def fan_out(prompts: DataFrame, client: Client, key: str, prompt: str, retries: int = 0, accept: Callable[[str], bool] | None = None, concurrent: int = 12) -> DataFrame:
    """(key, status, reply, attempts) of each prompt's call, on the executors; a failed call is a row, not an error.

    A task has up to ``concurrent`` calls under way at a time; rows keep the order of the prompts.
    """

    def one(job: tuple[str, str]) -> tuple[str, str, str | None, int]:
        k, text = job
        status, reply, attempt = "query_failed", None, 0
        for attempt in range(1, retries + 2):
            try:
                reply = client(text)
            except Exception as e:  # the row says what went wrong
                status, reply = "query_failed", str(e)
                continue
            status = "ok" if accept is None or accept(reply) else "invalid"
            if status == "ok":
                break
        return k, status, reply, attempt

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrent) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, zip(batch["key"], batch["prompt"], strict=True))), columns=REPLY.names)

    return prompts.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt")).mapInPandas(call, REPLY)


def naming_status(replies: DataFrame) -> DataFrame:
    """Parsed and validated segment names: fields, errors and status."""
    parsed = replies.withColumn("x", parse_reply("reply", NAMING_SCHEMA))
    out = parsed.select("key", "x.*", schema_errors({"segment_name": F.col("x.segment_name"), "description": F.col("x.description")}, {"evidence": F.col("x.evidence")}).alias("errors"))
    return out.withColumn("status", F.when(F.size("errors") == 0, "OK").otherwise("NAMING_FAILED"))


def merge_personas(customers: DataFrame, personas: DataFrame, segment: str = "segment") -> DataFrame:
    """Customers with their segment's persona; lists become JSON text; every customer stays once."""
    cells = {"evidence": F.to_json(F.coalesce("evidence", F.array().cast("array<string>"))), "cautions": F.to_json(F.coalesce("cautions", F.array().cast("array<string>")))}
    have = [c for c in ("segment_name", "description", "evidence", "cautions", "status") if c in personas.columns]
    padded = personas.select(segment, *[cells.get(c, F.col(c)).alias(c) for c in have], *[F.lit(None).cast("string").alias(c) for c in ("segment_name", "description", "evidence", "cautions", "status") if c not in have])
    return customers.join(padded, segment, "left")


def validate_merge(merged: DataFrame, customers: int, personas: DataFrame, segment: str = "segment") -> DataFrame:
    """Raise where rows were lost or doubled, a segment lacks a persona row, or a persona has no customers."""
    from tidemark.operators.quality import IntegrityError, require_clean

    require_clean(merged, {"customer without a name or status": "segment_name IS NULL AND coalesce(status, '') <> 'NAMING_FAILED'"}, ("customer_id",), customers)
    extra = personas.join(merged.select(segment).distinct(), segment, "left_anti").limit(5).collect()
    if extra:
        raise IntegrityError(f"personas of unknown segments: {[r[segment] for r in extra]}")
    return merged


def roll_up(labels: DataFrame) -> DataFrame:
    """Number of label rows by status."""
    return labels.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def label_status(df: DataFrame, reply: str, labels: str, valid: str) -> DataFrame:
    """Status of each labelling: the query failed, the reply doesn't read, nothing fits, or ok."""
    return df.withColumn("status", F.when(F.col(reply).isNull(), "query_failed").when(F.col(labels).isNull(), "unparseable").when((F.size(valid) == 0) | (F.array_contains(valid, "Unrepresentable")), "unrepresentable").otherwise("ok"))


def set_summary(personas: DataFrame) -> DataFrame:
    """By dataset, rows, distinct names and mean length of definitions."""
    return personas.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("name").alias("names"), F.avg(F.length("definition")).alias("mean_length"))


def best_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """By item of the left set, the item of the right set with the most similar tokens.

    Candidates come from a join on shared tokens, so unrelated items are never paired.
    """
    a = left.select(F.col("name").alias("a"), F.col("tokens").alias("ta"))
    b = right.select(F.col("name").alias("b"), F.col("tokens").alias("tb"))
    pairs = a.withColumn("t", F.explode("ta")).join(b.withColumn("t", F.explode("tb")), "t").select("a", "b", "ta", "tb").distinct()
    scored = pairs.select("a", "b", jaccard("ta", "tb").alias("similarity"))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), F.asc("b"))
    best = scored.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
    return a.select("a").join(best, "a", "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def split_items(pairs: DataFrame, share: float = 0.8, salt: str = "split") -> DataFrame:
    """Items of each user in a hash order, the first ones (at least one) for training."""
    order = Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit(salt + ":"), F.col("user_id").cast("string"), F.lit(":"), F.col("item_id").cast("string")).cast("binary")), "item_id")
    every = Window.partitionBy("user_id")
    return pairs.withColumns({"at": F.row_number().over(order), "n": F.count(F.lit(1)).over(every)}).select("user_id", "item_id", F.when(F.col("at") <= F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1)), "train").otherwise("test").alias("part"))


def map_reduce_rounds(texts: Sequence[str], client: Client, sizes: Sequence[int]) -> str:
    """Rounds of prompts that merge lists: each round joins ``size`` texts into one prompt, until one text is left."""
    now = list(texts)
    for i, size in enumerate(sizes):
        prompt = ROUND_PROMPTS[min(i, len(ROUND_PROMPTS) - 1)]
        now = [client(prompt % "\n\n".join(now[j : j + size])) for j in range(0, len(now), size)]
    return now[0] if len(now) == 1 else client(ROUND_PROMPTS[-1] % "\n\n".join(now))


def offline_client(prompt: str) -> str:
    """A client without a network: a reply that follows from the prompt alone."""
    digest = hashlib.md5(prompt.encode()).hexdigest()[:6]
    return f'Reply: {{"segment_name": "Segment {digest}", "description": "Made offline", "evidence": ["{len(prompt)} characters"], "cautions": []}}'


def http_client(url: str, model: str, key_variable: str, timeout: float = 60.0) -> Client:
    """A client of a chat endpoint over HTTP; the key is read from the environment where the call is made."""

    def call(prompt: str) -> str:
        import json
        import os
        import urllib.request

        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[key_variable]}"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return call


def format_sets(personas: DataFrame) -> DataFrame:
    """By dataset, its personas as one text for a prompt: a numbered line each, by number."""
    parts = F.array_sort(F.collect_list(F.struct("no", "name", "definition")))
    line = lambda p: F.concat(p["no"].cast("string"), F.lit(". "), p["name"], F.lit(" - "), p["definition"])
    return personas.groupBy("dataset").agg(F.array_join(F.transform(parts, line), "\n").alias("text"))


def persona_index(taxonomy: DataFrame, labels: DataFrame) -> DataFrame:
    """(persona, idx): the taxonomy (no, name) in its order, then names that only labels have, by name."""
    known = taxonomy.groupBy(F.col("name").alias("persona")).agg(F.min("no").alias("no"))
    extra = labels.select("persona").distinct().join(known, "persona", "left_anti").withColumn("no", F.lit(None).cast("long"))
    order = Window.orderBy(F.asc_nulls_last("no"), "persona")  # a taxonomy is a short list
    return known.unionByName(extra).select("persona", (F.row_number().over(order) - 1).cast("long").alias("idx"))


def label_matrix(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(user_id, idx) of every label once: the ones of the user by persona matrix."""
    return labels.join(F.broadcast(index), "persona").select("user_id", "idx").distinct()


def require_labels(labels: DataFrame, users: DataFrame) -> DataFrame:
    """Labels of the users; raises if one has none, or one that says nothing fits."""
    from tidemark.operators.quality import IntegrityError

    found = labels.join(users, "user_id", "left_semi")
    bad = users.join(labels, "user_id", "left_anti").unionByName(found.where(F.col("persona") == "Unrepresentable").select("user_id")).limit(5).collect()
    if bad:
        raise IntegrityError(f"users without a usable label: {[r['user_id'] for r in bad]}")
    return found
