import pathlib
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as d


def brute_force(text, items, window=13):
    words = d.words_of(text)
    hit, found = set(), set()
    for item, own in items:
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


def test_words():
    assert d.words_of("It's A-b_ÄÉ 12\u00a0x") == ["it", "s", "a", "b", "ÄÉ", "12\u00a0x"]
    assert d.words_of(None) == d.words_of("?! _") == []


def cases(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((0, 1, 2, 5, 12, 13, 14, 30, 30))] + [("8", "w1 w2"), (None, "w3 w4 w5")]
    texts = [None, "", "w1", "W1, W2!", *(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    texts += [f"x {t.upper()} y {t}" for _, t in items] + [items[7][1][3:-3], "w0 " * 3000]
    return items, texts


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_equals_brute_force(spark, limit):
    items, texts = cases()
    bench = spark.createDataFrame([(i, t) for i, t in items] + [("20", None)], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' AS runs", "1 AS n_words", "2 AS item_id")
    got = d.contamination(docs, bench, max_pattern_words=limit).collect()
    assert len(got) == len(texts)
    pairs = [(i, d.words_of(t)) for i, t in items]
    for r in got:
        n, hit, found = brute_force(texts[r["doc_id"]], pairs)
        assert (r["__tm_scan"]["n_words"], r["__tm_hit"], sorted(r["__tm_scan"]["items"])) == (n, hit, found)


@pytest.mark.parametrize("window", [1, 2, 3, 8, 13])
def test_matcher_equals_brute_force_at_any_window(window):
    rng = random.Random(window)
    for vocab_size in (1, 2, 4):
        vocab = [f"w{i}" for i in range(vocab_size)]
        words = lambda n: [rng.choice(vocab) for _ in range(n)]
        items = [(str(i), words(rng.randint(0, 3 * window))) for i in range(5)]
        m = d.Matcher(items, window)
        for _ in range(60):
            text = words(rng.randint(0, 5 * window)) + rng.choice(items)[1][rng.randint(0, 3) :] + words(2)
            runs, found = m.scan(text)
            assert (len(text), sum(b - a for a, b in runs), sorted(found)) == brute_force(" ".join(text), items, window)


def test_worker_keeps_the_automata_that_fit(monkeypatch):
    monkeypatch.setattr(d, "_BUILT", {})
    monkeypatch.setattr(d, "KEPT_WORDS", 10)
    parts = {k: [(k, [k, "b", "c", "d"])] for k in "xyz"}
    first = {k: d._matcher(k, v, 13) for k, v in list(parts.items())[:2]}
    assert all(d._matcher(k, parts[k], 13) is m for k, m in first.items())
    d._matcher("z", parts["z"], 13)
    assert list(d._BUILT) == ["y", "z"] and d._matcher("x", parts["x"], 13) is not first["x"]


def test_memory_of_a_full_part_is_bounded():
    code = """
import random, resource, sys
sys.path.insert(0, %r)
from tidemark.llm import decontaminate as d
rng = random.Random(1)
items = [(str(i), [f"w{rng.randrange(40000)}" for _ in range(100)]) for i in range(d.MAX_PATTERN_WORDS // 100)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = d.Matcher(items, 13)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = pathlib.Path(d.__file__).parents[2]
    got = subprocess.run([sys.executable, "-c", code % str(root)], capture_output=True, text=True, timeout=300, check=True)
    assert int(got.stdout) < 200


def test_spans_map_to_the_original_text():
    m = d.Matcher([("1", d.words_of("Alpha beta GAMMA"))], 13)
    text = "Say: ALPHA-beta, gamma! Then alpha beta."
    runs, items = m.scan(d.words_of(text))
    assert [text[a:b] for a, b in d.original_spans(text, runs)] == ["ALPHA-beta, gamma"] and items == {"1"}


def test_rule_and_digest(spark):
    import hashlib

    row = spark.range(1).select(d.contaminated(F.lit(1), F.lit(20)).alias("a"), d.contaminated(F.lit(1), F.lit(21)).alias("b"), d.contaminated(F.lit(0), F.lit(0)).alias("c"), d.items_digest(F.array(F.lit("9"), F.lit("10"), F.lit("9"))).alias("h")).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, False) and row["h"] == hashlib.sha256(b"10,9").hexdigest()


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox"), (None, None)], "item_id long, text string")
    got = d.contamination(odd_docs, bench).select("doc_id", "__tm_hit").collect()
    assert sorted((r["doc_id"] or 0, r["__tm_hit"]) for r in got if r["__tm_hit"]) == [(1, 3), (1, 3)] and len(got) == odd_docs.count()
    assert d.contamination(no_docs, bench).count() == 0
    assert d.contamination(odd_docs, bench.limit(0)).where("__tm_hit > 0").count() == 0
