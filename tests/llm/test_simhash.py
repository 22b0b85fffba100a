import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "Two Words", "three Ärger words", "a b c d e f g " * 50, "x y z\x0bq"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(not m & d for m in masks)


def test_level_below_covers_what_a_mask_leaves_free():
    for m in simhash.covering_masks(list(range(64)), 3):
        free = [p for p in range(64) if not m >> p & 1]
        sub = simhash.covering_masks(free, 3)
        assert all(any(not s & (1 << a | 1 << b | 1 << c) for s in sub) for a, b, c in itertools.combinations(free, 3))


def planted(seed, n, groups):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for size in groups:
        now = rng.getrandbits(64)
        for _ in range(size):
            for _ in range(rng.randint(0, 3)):
                now ^= 1 << rng.randrange(64)
            out.append(now)
        centre = rng.getrandbits(64)
        out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(size)]
    return out


@pytest.mark.parametrize("limit", [1024, 24])
def test_components_equal_brute_force_also_with_split_buckets(spark, limit):
    prints = sorted(set(planted(4, 60, (30, 60))))
    nodes = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "nid long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.candidate_edges(nodes, 3, limit)).collect()}
    assert {i: found.get(i, i) for i in range(len(prints))} == classes(dict(enumerate(prints)))


def test_long_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in simhash.components(edges).collect()} == {0}


def test_rounds_that_run_out_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(edges, max_rounds=2)


def test_rows_without_an_id_link_like_any_other(spark, monkeypatch):
    prints = {"a": 0, "bridge": 0b111, "b": 0b111111, "far": (1 << 64) - 1, "lone": 0xFFFF}
    rows = [("x", "a"), (None, "bridge"), ("k", "b"), (None, "far"), ("z", "lone")]
    column = lambda text: F.create_map(*[F.lit(v) for k, p in prints.items() for v in (k, simhash.signed(p))])[text]
    monkeypatch.setattr(simhash, "fingerprint_column", column)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {("x", "k"), (None, "k"), ("k", "k"), (None, None), ("z", "z")}


def test_query_on_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = classes({i: slow_fingerprint(t) for i, t in ((r["doc_id"], r["text"]) for r in odd_docs.collect()) if i is not None})
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(no_docs).count() == 0
