import re

import pytest

from tidemark.llm import url_filter
from tidemark.llm.queries import RULES

PAGES = "page_id long, url string, html string"


def slow_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def slow_rule(host, path):
    fit = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://www.Example.COM/en/1?x#y", "https://example.com/en/", "https://m.example.com/en", "http://a.net/es/x", "http://net/fr/", "http://anet/fr/", "http://x.com", "http://x.com?/en/",
    "ftp://ü.Ö.com/a b", "no scheme", "", None, "://h.net/fr/", "http://", "a://b://c.com/", "http://example.com/en/\nq", "HTTP://X.ORG#://y.com/",
]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], "")], PAGES)
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = slow_parts(URLS[r["page_id"]])
        rule, action = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == (action or "allow")


@pytest.mark.parametrize("as_table", [False, True])
def test_joined_rules_equal_expressions(spark, as_table):
    rules = [*RULES, ("block", "com", "/"), ("allow", "x.com", ""), ("block", "c.com", "/x"), ("block", "com", "/xy"), ("allow", "ö.com", "/a"), ("block", "ü.ö.com", "/a b")]
    urls = [*URLS, "http://x.com/xyz", "http://a.b.c.com/xy/z", "http://c.com/x", "http://.com/", "http://com./", "http://a..com/xy"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], "")], PAGES)
    want = sorted(map(str, url_filter.judge(df, rules).collect()))
    given = url_filter.rule_table(spark, rules) if as_table else rules
    assert sorted(map(str, url_filter.judge(df, given, expression_rules=2).collect())) == want
    many = [("block", f"h{i}.org", "/") for i in range(3000)]
    assert [r["rule"] for r in url_filter.judge(spark.createDataFrame([(1, "http://www.h2999.org/a", None)], PAGES), many).collect()] == ["h2999.org/"]


def slow_rank(weights, shares, damping, rounds=400):
    moved = {h: w * (1 - damping) for h, w in weights.items() if w > 0}
    score = dict(moved)
    for _ in range(rounds):
        new = {}
        for frm, to, share in shares:
            if frm in moved:
                new[to] = new.get(to, 0) + damping * moved[frm] * share
        moved = new
        for h, x in moved.items():
            score[h] = score.get(h, 0) + x
    return score


@pytest.mark.parametrize("hub_edges", [1000, 2])
@pytest.mark.parametrize("against", [False, True])
def test_propagation_equals_brute_force(spark, against, hub_edges):
    edges = [(f"h{a}", f"h{b}") for a in range(8) for b in range(8) if a != b and (a * 3 + b) % 4 == 0]
    out = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    shares = [(b, a, 1 / out[a]) if against else (a, b, 1 / out[a]) for a, b in edges]
    weights = {"h0": 1.0, "h3": 0.5, "h7": 0.0}
    seeds = spark.createDataFrame(list(weights.items()), "host string, weight double")
    found = url_filter.propagate(seeds, spark.createDataFrame(shares, "frm string, to string, share double"), 0.85, 1e-4, every=4, hub_edges=hub_edges)
    assert {r["host"]: r["score"] for r in found.collect()} == pytest.approx(slow_rank(weights, shares, 0.85), abs=1e-3)


@pytest.mark.parametrize("hosts", [1, 2, 12])
def test_a_farm_of_any_size_is_blocked(spark, hosts):
    rows = [(0, "http://spam.net/es/", None)]
    rows += [(1 + i, f"http://farm{i}.org/", f'<a href="http://spam.net/x">x</a><a href="http://farm{(i + 1) % hosts}.org/">y</a>') for i in range(hosts)]
    rows += [(100, "http://news.org/", "".join(f'<a href="http://{h}/">x</a>' for h in ("spam.net", "a.org", "b.org", "c.org")))]
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert {verdict[i] for i in range(hosts + 1)} == {"block"} and verdict[100] == "allow"


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    bad = [(i, f"http://spam.net/es/{i}", None) for i in range(4)]
    friend = [(10, "http://farm.org/1", '<a href="http://spam.net/es/1">x</a><a class=q href=//spam.net/x>y</a>')]
    good = [(20, "http://fine.com/1", "<a href='https://Partner.org/a'>x</a>"), (21, "http://partner.org/2", None)]
    other = [(30, "http://lone.org/", None), (40, "http://spam.net/en/", None)]
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(bad + friend + good + other, PAGES), RULES).collect()}
    # farm.org takes 0.85 of spam.net's distrust and has no trust
    assert verdict == {0: "block", 1: "block", 2: "block", 3: "block", 10: "block", 20: "allow", 21: "allow", 30: "allow", 40: "block"}


def test_empty_and_clashing(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), RULES).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/", None)], PAGES).selectExpr("*", "1 AS host", "2 AS rule", "3 AS verdict", "4 AS src", "5 AS score")
    assert [r["verdict"] for r in url_filter.judge(df, RULES).collect()] == ["allow"]


def test_no_python_in_the_plan(spark):
    plan = url_filter.judge(spark.createDataFrame([(1, "http://a.com/", None)], PAGES), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan.replace("createDataFrame", ""))


def test_sql_spreads_the_same_way(spark):
    import duckdb
    import pandas as pd

    from tidemark.llm.queries import oracle_sql

    hosts = [f"h{i}.{d}" for i, d in enumerate(("com", "org", "net", "org", "net", "org", "example.com"))]
    rows = []
    for i, h in enumerate(hosts):
        links = "".join(f'<a class="c" href="http://{hosts[j]}/x">l</a>' for j in range(7) if (i * 5 + j * 3) % 4 == 0)
        rows += [(10 * i + k, f"http://{h}/{part}/1", links) for k, part in enumerate(("en", "es", "fr"))]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(map(str, con.execute(oracle_sql()["op7_url_filter"]).fetchall()))
    got = url_filter.judge(spark.createDataFrame(pages, PAGES), RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want and len({r["verdict"] for r in got if r["rule"] is None}) == 2
