from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.water_fill([0, 10], [5, 2]) == pytest.approx([0, 15])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0], [5]) == [0]
    sizes = [7, 1000, 3, 40, 500, 2]
    got = mixing.water_fill(sizes, [5, 2, 1, 5, 2, 1])
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    got = mixing.permute(np.arange(n), n, 99)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 17 or got.tolist() != mixing.permute(np.arange(n), n, 100).tolist()


@pytest.mark.parametrize("limit", [mixing.LIBRARY_LIMIT, 10])
def test_counts_of_all_shards_fit_together(monkeypatch, limit):
    plan = mixing.MixPlan((10, 5, 50, 9), (20, 7, 63, 0), (1, 1, 1, 0), 8, 3)
    monkeypatch.setattr(mixing, "LIBRARY_LIMIT", limit)
    seen, each = np.zeros(4, dtype=int), {}
    for shard, sids, n, before in plan.counts(0, plan.shards):
        assert before.tolist() == seen[sids].tolist() and n.sum() == min(8, 90 - 8 * shard) and (n > 0).all()
        seen[sids] += n
        each[shard] = (sids.tolist(), n.tolist(), before.tolist())
    assert seen.tolist() == [20, 7, 63, 0] and list(each) == list(range(plan.shards))
    ranges = [c for a in range(0, plan.shards, 5) for c in plan.counts(a, min(plan.shards, a + 5))]
    assert {s: (i.tolist(), n.tolist(), b.tolist()) for s, i, n, b in ranges} == each


def test_draws_beyond_the_library_are_as_random(monkeypatch):
    rng = np.random.default_rng(5)
    want = rng.hypergeometric(30, 50, 20, size=6000)
    monkeypatch.setattr(mixing, "LIBRARY_LIMIT", 4)
    got = np.array([mixing.hypergeometric(rng, 30, 50, 20) for _ in range(6000)])
    assert abs(got.mean() - 7.5) < 0.12 and abs(got.var() - want.var()) < 0.25 and got.min() >= 0 and got.max() <= 20
    for good, bad, take in ((5, 0, 3), (0, 5, 3), (5, 5, 10), (5, 5, 0)):
        x = mixing.hypergeometric(rng, good, bad, take)
        assert max(0, take - bad) <= x <= min(good, take)
    monkeypatch.undo()
    huge = mixing.hypergeometric(rng, 10**13, 3 * 10**13, 10**12)
    assert abs(huge - 10**12 / 4) < 10**7


@pytest.mark.parametrize("cap", [1.2, 2.0])
@pytest.mark.parametrize("size", [1, 16, 17, 31, 32, 130, 600])
def test_quotas_are_exact_to_the_word(size, cap):
    for target in (0, 0.4, 1, size / 2, size - 1, size, size + 1, 1.5 * size, cap * size):
        n, last = mixing.quota_of(size, target, 16, cap)
        want = min(round(target), int(cap * size + 1e-9))
        used = Counter()
        for j in range(n):
            turn, at = divmod(j, -(-size // 16))
            block = int(mixing.position(np.array([at]), -(-size // 16), turn)[0])
            words = min(16, size - 16 * block)
            used[block] += min(words, last) if j == n - 1 else words
        assert sum(used.values()) == want


def docs_of(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range((i * 37) % 90)), ["a", "b", None][i % 7 % 3]) for i in range(120)] + [(500, "long " * 5000, "a"), (501, None, "b"), (502, "", "zero")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix_takes_what_the_targets_say(spark):
    rows, docs = docs_of(spark)
    got = mixing.mix(docs, block=16, shard_slots=32).taken().collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for r in got:
        own = source[r["doc_id"]]
        assert r["source_size"] == sum(n for i, n in size.items() if source[i] == own)
        assert abs(taken[own] - r["target"]) <= 0.5
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), block=16, shard_slots=32).taken().collect()))


def test_small_sources_and_fractional_caps(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(130, "a"), (600, "b"), (3, "c"), (1000, "d"), (250, "d")])]
    for cap in (1.2, 2.0):
        taken = Counter()
        for r in mixing.mix(spark.createDataFrame(rows, DOCS), cap=cap).taken().collect():
            taken[rows[r["doc_id"]][2]] += r["taken"]
            assert r["taken"] <= 2 * r["size"] and r["target"] <= cap * r["source_size"] + 1e-6
        sizes = [130, 600, 3, 1250]
        want = mixing.water_fill(sizes, [5, 2, 1, 5], 1.5, cap)
        assert all(abs(taken[s] - t) <= 1 for s, t in zip("abcd", want, strict=True))


def test_repeated_rows_are_packed_as_often(spark):
    rows = [(1, "a b c", "s")] * 40 + [(1, "a b", "s")] * 3 + [(None, "x y", None)] * 5
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=4, shard_slots=8).taken().collect()
    assert len(got) == 48 and sum(r["taken"] for r in got) == 204
    spans = mixing.mix(spark.createDataFrame(rows, DOCS), block=4).rows.where("sid = 0").orderBy("start").collect()
    at = 0
    for r in spans:
        assert r["start"] == at
        at += r["size"]


def test_more_sources_than_allowed_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(i, "w", str(i)) for i in range(4)], DOCS), max_sources=3)


def test_offsets_are_a_running_sum_over_levels(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 11) for i in range(300)], "doc_id long, sid long, size long")
    for fan in (2, 1024):
        got = mixing.offsets(rows, 300, bin_rows=4, fan=fan).collect()
        for s in range(3):
            own = sorted((r for r in got if r["sid"] == s), key=lambda r: (r["bin"], r["nr"]))
            at = 0
            for r in own:
                assert r["start"] == at
                at += r["size"]


def test_blocks_hold_the_texts_words(spark):
    rows, docs = docs_of(spark)
    m = mixing.mix(docs, block=16, shard_slots=32)
    blocks = mixing.materialise_blocks(m, docs).collect()
    assert len(blocks) == sum(m.plan.quotas)
    words = Counter(w for r in blocks for w in r["text"].split())
    taken = {r["doc_id"]: r["taken"] for r in m.taken().collect()}
    for i, t, _ in rows:
        if i < 500 and t:
            assert sum(words[w] for w in t.split()) == taken[i]
    assert all(len(r["text"].split()) <= 16 for r in blocks)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).taken().collect()
    assert len(got) == odd_docs.count()
    assert {(r["size"], r["taken"] <= 2 * r["size"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(0, True)}
    assert mixing.mix(no_docs).taken().count() == 0
