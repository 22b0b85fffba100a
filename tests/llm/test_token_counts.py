import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return tc.Counter(f.read())


def test_splitting_is_allowed(counter):
    assert counter.splits and 0 < len(counter.lengths.frequent) <= counter.model.get_piece_size()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t <s>/aé"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_counts_equal_the_library(counter, text):
    assert counter.count(text) == len(counter.model.encode(text))


def test_cache_that_overflows_stays_exact(counter, monkeypatch):
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 3)
    text = " ".join(f"word{i} other{i}" for i in range(50))
    assert counter.by_parts(text) == len(counter.model.encode(text))


def test_query_rows(spark, odd_docs, no_docs, counter):
    got = odd_docs.select("text", tc.count_column(F.col("text"), spark, PATH, limit=9).alias("c")).select("text", "c.*").collect()
    for r in got:
        assert r["n_tokens"] == len(counter.model.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 9)
    assert no_docs.select(tc.count_column(F.col("text"), spark, PATH)).count() == 0
