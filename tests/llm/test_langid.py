import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import in_fold

ROWS = [("the cat sat on the mat and the dog ran", "en"), ("le chat est sur la table avec le chien", "fr"), ("кот сидит на столе", "ru")]


def test_spans_of_mixed_text():
    m = langid.fit(ROWS * 10)
    text = "the cat sat on the mat, le chat est sur la table: кот сидит"
    spans = m.spans(text)
    assert [s["lang"] for s in spans] == ["en", "fr", "ru"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["the cat sat on the mat", "le chat est sur la table", "кот сидит"]


def labelled(m, table):
    """The operator's labels where the words have these scores."""
    words = [f"w{i}" for i in range(len(table))]
    m._index, m._table = {w: i + 1 for i, w in enumerate(words)}, np.vstack([np.zeros((1, table.shape[1])), table])
    return m.label(words)


def value(m, table, path):
    return table[np.arange(len(path)), path].sum() - m.switch_penalty * (np.diff(path) != 0).sum()


@pytest.mark.parametrize("langs", [3, 4, 5])
def test_labels_are_optimal_among_all_paths(langs):
    rng = np.random.default_rng(langs)
    m = langid.fit([(w, w) for w in "abcde"[:langs]])
    for _ in range(3500):
        table = -rng.random((rng.integers(1, 6), langs)) * rng.choice([1, 4, 9])
        table -= table.max(axis=1, keepdims=True)
        paths = np.array(list(itertools.product(range(langs), repeat=len(table))))
        best = (table[np.arange(len(table)), paths].sum(axis=1) - m.switch_penalty * (np.diff(paths, axis=1) != 0).sum(axis=1)).max()
        assert np.isclose(value(m, table, labelled(m, table)), best)


def test_labels_of_long_texts_equal_the_full_dynamic_programme():
    rng = np.random.default_rng(3)
    m = langid.fit(ROWS * 10)
    for _ in range(300):
        table = -rng.random((rng.integers(1, 40), 3)) * rng.choice([1, 4, 9])
        assert np.isclose(value(m, table, labelled(m, table)), value(m, table, m._viterbi(table)))


def test_two_switches_that_pay_only_together():
    m = langid.fit(ROWS * 10)
    assert labelled(m, np.array([[-4.0, 0, -9], [-4, -9, 0]])).tolist() == [1, 2]


def test_edge_texts():
    m = langid.fit(ROWS)
    assert [m.predict(t) for t in (None, "", "12 !?", "½ ² Ⅷ_")] == [("und", 0.0)] * 4
    assert m.predict("кот")[0] == "ru" and 0 < m.predict("漢字 the cat")[1] < 1
    assert langid.fit([]).predict("abc") == ("und", 0.0)
    assert m.predict("the cat " * 50000)[0] == "en"


def test_every_text_with_a_letter_gets_a_learned_language():
    latin = langid.fit([r for r in ROWS if r[1] != "ru"] * 10)
    for text in ("zzxq", "x", "qqq vvv", "кот сидит", "漢字", "ﬁ", "1a2", "x²"):
        lang, score = latin.predict(text)
        assert lang in ("en", "fr") and 0 <= score <= 1, text
    assert latin.predict("кот сидит") == ("en", 0.0)
    assert [s["lang"] for s in latin.spans("кот the cat sat")] == ["und", "en"]


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        got = docs.select("doc_id", "text", langid.predict_column(langid.train(docs), F.col("text"), spark).alias("p")).select("text", "p.*").collect()
        assert len(got) == docs.count()
        for r in got:
            if not any(c.isalpha() for c in r["text"] or ""):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            elif docs is odd_docs:
                assert r["lang_pred"] != "und"


def test_sample_is_bounded_where_an_id_repeats(spark):
    docs = spark.range(600).selectExpr("id % 2 AS doc_id", "concat('word ', id) AS text", "'en' AS lang")
    known = docs.where(langid.crc_mod("doc_id", 3) != 1)
    assert known.count() > 100 and langid.at_most_rows(known, 20, "doc_id", "lang", "text").count() == 20
    assert langid.train(docs, sample_rows=10).langs in ([], ["en"])


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long").select(in_fold("doc_id", 3, 1).alias("h"))
    assert [r["h"] for r in df.collect()][0] is False


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.train(docs)
    held = docs.where((langid.crc_mod("doc_id", 3) == 1) & F.col("lang").isNotNull()).collect()
    assert sum(m.predict(r["text"])[0] == r["lang"] for r in held) >= 0.97 * len(held)
