import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = ["idiot", "worthless", "scum", "disgusting", "moron"]


def test_automaton_finds_what_brute_force_finds():
    rng, trie = random.Random(5), toxicity.Trie(TERMS, ["chlla"])
    words = set()
    for t in [*TERMS, "chllaba", "hello", "scam"]:
        for _ in range(400):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(w) + 1), rng.random()
                if kind < 0.4:
                    w.insert(at, rng.choice("aeixz01"))
                elif w and at < len(w):
                    w[at : at + 1] = [] if kind < 0.7 else [rng.choice("aeixz01")]
            words.add("".join(w))
    for w in words - {""}:
        near = sorted((edits(w, t), t) for t in TERMS if edits(w, t) <= toxicity.allowed(t))
        stem = [(0, "chlla")] if w.startswith("chlla") else []
        best = min([*near, *stem], default=None)
        got = trie.match(w)
        assert (got and (got[1], got[0])) == best, w


def test_quoted_hits_are_told_from_direct_ones():
    model = toxicity.ToxicityModel(TERMS, [])
    assert [h["quoted"] for h in model.hits('he said "you idiot" to me')] == [True]
    assert [h["quoted"] for h in model.hits("you idiot, go away")] == [False]
    assert model.score('he said "you idiot" to me') < model.score("you idiot, go away")
    hit = model.hits("What an idi0t!")[0]
    assert (hit["term"], hit["edits"], hit["start"], hit["end"]) == ("idiot", 1, 8, 13)


def test_lexicon_is_learned_with_terms_and_stems():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("ta", "ro", "mi", "lu", "ne", "so")) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(30)) for _ in range(200)]
    bad = [" ".join([*(word() for _ in range(30)), rng.choice(["zidiot", "zscum"])]) for _ in range(60)] + [" ".join([*(word() for _ in range(30)), "vequ" + word() + word()]) for _ in range(60)]
    model = toxicity.fit(bad, clean)
    assert {"zidiot", "zscum"} <= set(model.terms) and model.stems == ["vequ"]
    assert all(model.score(t) >= 0.3 for t in bad) and all(model.score(t) < 0.3 for t in clean)


def test_stems_that_clean_rows_have_too_are_judged_by_their_number():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("ta", "ro", "mi", "lu", "ne", "so")) for _ in range(rng.randint(1, 4)))
    bad_word = lambda: "vequ" + word() + word()
    clean = [" ".join([*(word() for _ in range(30)), *([bad_word()] if i % 20 == 0 else [])]) for i in range(600)]
    bad = [" ".join([*(word() for _ in range(30)), *(bad_word() for _ in range(8))]) for _ in range(80)]
    model = toxicity.fit(bad, clean)
    assert model.stems == ["vequ"] and not [t for t in model.terms if t.startswith("vequ")]
    new = [" ".join(f"vequxyz{e}" for e in "abcdefgh"[:n]) for n in (1, 8)]
    assert [h["term"] for h in model.hits(new[0])] == ["vequ"] and model.score(new[0]) < 0.3 <= model.score(new[1])
    assert model.score(" ".join(["vequxyza"] * 8)) == model.score(new[0])


def test_only_branches_that_a_word_opens_with_are_walked_for_stems():
    trie = toxicity.Trie(["vxxxxxxxx"], ["vequ", "vetano"])
    assert trie.match("vequab") == ("vequ", 0, True) and trie.match("vetano") == ("vetano", 0, True)
    assert trie.match("vetan") is None and trie.match("veq") is None and trie.match("avequ") is None


def test_misspelt_terms_count_where_clean_rows_have_none():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("ta", "ro", "mi", "lu", "ne", "so")) for _ in range(rng.randint(1, 4)))
    line = lambda *more: " ".join([*(word() for _ in range(20)), *more])
    model = toxicity.fit([line(rng.choice(["zidiot", "vcum"])) for _ in range(150)], [line() for _ in range(400)])
    assert all(model.score(line(w)) >= 0.3 for w in ("zidiot", "zid1ot", "zidiiot", "vcum", "zidi0t"))
    assert model.score(line("vc0m")) < 0.3 and model.score(line()) < 0.3


def test_a_large_group_of_copies_is_no_lexicon():
    rng = random.Random(2)
    texts = [" ".join(str(rng.random()) for _ in range(20)) for _ in range(5)]
    assert toxicity.without_copies(texts + [texts[0]] * 50 + [texts[0] + " more"]) == texts


def test_odd_rows_and_fold_rule(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxicity.train(docs, labels)
        rows = docs.select("doc_id", "text", toxicity.score_column(model, F.col("text"), spark).alias("s")).collect()
        assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
        assert len({r["s"] for r in rows if not (r["text"] or "").strip()}) <= 1
    empty = toxicity.train(odd_docs, labels.limit(0))
    assert empty.terms == [] and list(empty.weights) == pytest.approx(list(toxicity.PRIOR))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.crc_mod("doc_id", 4) == 2).select("toxic", "text").collect()
    assert model.stems
    scores = sorted((model.score(r["text"]), r["toxic"]) for r in held)
    pos = sum(y for _, y in scores)
    ahead, wrong = 0, 0
    for _, y in scores:  # pairs that the scores order wrongly
        ahead += y
        wrong += ahead if not y else 0
    assert 1 - wrong / (pos * (len(held) - pos)) >= 0.95
    right = sum((model.score(r["text"]) >= 0.3) == bool(r["toxic"]) for r in held)
    assert right >= 0.93 * len(held)
