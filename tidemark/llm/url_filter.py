"""URL filters: host and path rules first, then trust and distrust that spread over the link graph.

All of it is DataFrame expressions. Links found in the pages become edges between hosts, and both scores
are personalised PageRank from seed hosts, whose weight is the share of the host's pages that a rule
allows (trust) or blocks (distrust). Trust flows along the edges. Distrust flows against them, from a host
to those that link to it: a host's distrust is the mass that the PageRank of a reader who starts there puts
on blocked seeds. It depends on what the host links to, not on how many others link there too, so a
farm of any number of hosts around one blocked host is judged as one such host is. Rounds go on until no
score moves by more than a tolerance.

A host is blocked where its distrust is greater than its trust and reaches what a host has that is blocked on
``threshold`` of its pages and links nowhere. Pages that no rule fits get their host's verdict.

Rules of any number: some are turned into expressions; more become a table that is joined by the suffixes
of a host and the prefixes of a path, at the lengths that rules of that host have. Hosts with very many edges
are dealt out to several join keys.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; null
or empty html has no links; hosts that no seed reaches are allowed; of several rules that fit, the
longest (host and path together) wins, then the first in code-point order (block after allow, if only the
action differs). Rows come back as often as they are given.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, remove

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
EXPRESSION_RULES = 200
HUB_EDGES = 1_000_000
RULE = "struct<rule:string,action:string>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_order(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The rules (action, host, path) from the one that wins over all others downwards."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The rule (action, host, path) that fits and is longest, as struct (rule, action); null if none."""
    cases = [F.when(fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in rule_order(rules)]
    return F.coalesce(*cases) if cases else F.lit(None).cast(RULE)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as rows (action, rule_host, rule_path)."""
    text = json.dumps([dict(zip(("action", "rule_host", "rule_path"), r, strict=True)) for r in rules])
    parsed = F.from_json(F.lit(text), "array<struct<action:string,rule_host:string,rule_path:string>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def joined_rules(own: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``hit`` as :func:`rule_of` does, for a table of rules (action, rule_host, rule_path).

    A host and path give a row for each suffix of the host and each length that paths of rules on that suffix
    have, so their number depends on the url and never on how many rules share a host.
    """
    sized = rules.withColumn("rule_length", F.length("rule_path"))
    lengths = sized.groupBy("rule_host").agg(F.collect_set("rule_length").alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = own.where("host <> ''").select("host", "path").distinct()
    probes = asked.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    probes = probes.select("host", "path", "rule_host", F.explode("lengths").alias("rule_length")).where(F.length("path") >= F.col("rule_length"))
    probes = probes.withColumn("rule_path", F.substr("path", F.lit(1), F.col("rule_length")))
    rule = F.concat("rule_host", "rule_path")
    first = F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.col("action").alias("action")))
    found = probes.join(sized.distinct(), ["rule_host", "rule_length", "rule_path"]).groupBy("host", "path").agg(first.alias("best"))
    return own.join(found, ["host", "path"], "left").withColumn("hit", F.when(F.col("best").isNotNull(), F.struct("best.rule", "best.action"))).drop("best")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct edges (src, dst) between different hosts, from the links of all pages."""
    target = lambda u: host_of(F.concat(F.lit("x://"), F.regexp_replace(u, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", "")))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1), target))
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(found).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


def max_rounds(damping: float, tolerance: float) -> int:
    """Rounds after which less than ``tolerance`` of any mass can still move."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(seeds: DataFrame, shares: DataFrame, damping: float, tolerance: float, every: int = 5, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Personalised PageRank (host, score) of seeds (host, weight): each round, ``frm`` passes on ``damping`` times ``share`` of what it got to ``to``.

    ``shares`` is (frm, to, share). A round moves only what the round before it brought. Rounds end when that is
    within the tolerance for every host. Hosts that pass on over more than ``hub_edges`` edges
    are split into several join keys.
    """
    spark = seeds.sparkSession
    hubs, hub_path = materialise(shares.groupBy("frm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges).select(F.col("frm").alias("host"), F.ceil(F.col("n") / hub_edges).alias("parts")), "hubs")
    split = not hubs.isEmpty()
    steps, steps_path = shares.select("frm", "to", (F.col("share") * damping).alias("w")), None
    if split:
        parts = steps.join(hubs.withColumnRenamed("host", "frm"), "frm", "left").withColumn("part", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))))
        steps, steps_path = materialise(parts.drop("parts"), "hub-edges")
    now = seeds.where("weight > 0").select("host", (F.col("weight") * (1 - damping)).alias("score"), (F.col("weight") * (1 - damping)).alias("moved"))
    path, rounds = None, max_rounds(damping, tolerance)
    for i in range(1, rounds + 1):
        active = now.where("moved > 0").select(F.col("host").alias("frm"), "moved")
        keys = ["frm"]
        if split:
            active = active.join(hubs.withColumnRenamed("host", "frm"), "frm", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
            keys = ["frm", "part"]
        arrived = active.join(steps, keys).select(F.col("to").alias("host"), (F.col("moved") * F.col("w")).alias("moved"))
        both = now.select("host", "score", F.lit(0.0).alias("moved")).unionByName(arrived.select("host", F.col("moved").alias("score"), "moved"))
        now = both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("moved").alias("moved"))
        if i % every == 0 or i == rounds:
            old = path
            now, path = materialise(now, "rank")
            if old:
                remove(spark, old)
            if (now.agg(F.max("moved")).first()[0] or 0.0) <= tolerance * (1 - damping):
                break
    for done in (hub_path, steps_path):
        if done:
            remove(spark, done)
    return now.select("host", "score")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    tolerance: float = 1e-3,
    threshold: float = 0.5,
    expression_rules: int = EXPRESSION_RULES,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules are tuples, or a table (action, rule_host, rule_path)."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, list) and len(rules) <= expression_rules:
        own = own.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    else:
        own = joined_rules(own, rule_table(spark, rules) if isinstance(rules, list) else rules)
    own = own.select("page_id", "host", "path", "hit.rule", "hit.action")
    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    seeds, _ = materialise(own.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    edges, _ = materialise(host_edges(pages, url_col, html_col), "host-edges")
    trust, distrust = seeds.select("host", F.col("trust").alias("weight")), seeds.select("host", F.col("distrust").alias("weight"))
    if edges.isEmpty():  # nothing can spread: every host keeps its own seed
        trust, distrust = ([x.where("weight > 0").select("host", (F.col("weight") * (1 - damping)).alias("score")) for x in (trust, distrust)])
    else:
        out = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("share"))
        links, _ = materialise(edges.join(out, "src"), "host-links")
        trust = propagate(trust, links.select(F.col("src").alias("frm"), F.col("dst").alias("to"), "share"), damping, tolerance)
        distrust = propagate(distrust, links.select(F.col("dst").alias("frm"), F.col("src").alias("to"), "share"), damping, tolerance)
    scored = distrust.withColumnRenamed("score", "bad").join(trust.withColumnRenamed("score", "good"), "host", "left")
    guilty = (F.col("bad") > F.coalesce("good", F.lit(0.0))) & (F.col("bad") > threshold * (1 - damping))
    blocked, _ = materialise(scored.where(guilty).select("host", F.lit("block").alias("spread")), "blocked")
    return own.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))
