"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle.

A sentencepiece BPE model whose normaliser changes nothing, and whose pieces never hold a space mark
after another character, can't merge across the start of a run of spaces: a text's count is the sum
over its pre-tokens (a run of space marks with what follows it). The first tier is a compact table of
frequent pre-tokens, sent to every worker once: the model's own whole-word pieces, which are the most
frequent pre-tokens of its training corpus. It has at most as many entries as the vocabulary, a bound
that no input changes. The second tier encodes what the table lacks and keeps the lengths in a worker
cache of bounded size. Whatever the tiers hold, the count is exact.

Both conditions on the model are checked when it is loaded; a model that fails them is counted by
encoding whole texts.

Defined results: null counts as the empty text (0 bytes, 0 tokens); white space, control characters
and special strings inside a text are ordinary text; whole texts are counted at any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_ENTRIES = 300_000
COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


class Lengths(dict):
    """Pre-token lengths: the frequent table, and a cache of those that were encoded."""

    def __init__(self, frequent: dict[str, int], model):
        super().__init__(frequent)
        self.frequent, self.model, self.misses = frequent, model, 0

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_ENTRIES + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self.misses += 1
        n = self[piece] = self._encode(piece)
        return n

    def _encode(self, piece: str) -> int:
        """Tokens of one pre-token: the model's dummy space takes the place of its first mark."""
        if piece[0] == MARK:
            return len(self.model.encode(piece[1:])) if len(piece) > 1 else 1
        return max(0, len(self.model.encode("\n" + piece)) - len(self.model.encode("\n")))


class Counter:
    """Counts tokens of whole texts as the model's library does."""

    def __init__(self, model_proto: bytes, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        self.splits = self._can_split()
        self.lengths = Lengths(frequent if frequent is not None else frequent_table(self.model), self.model)

    def _can_split(self) -> bool:
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probes = ("a b", " a", "a  b ", "ａ́", "a\tb\n", f"x{MARK}y", "é z")
        decoded = ("".join(self.model.encode(p, out_type=str)) for p in ("a  b ", "ａ"))
        plain = next(decoded) == f"{MARK}a{MARK}{MARK}b{MARK}" and len(next(decoded)) >= 1
        return plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and all(self.by_parts(p) == len(self.model.encode(p)) for p in probes)

    def by_parts(self, text: str, lengths: dict | None = None) -> int:
        if not text:
            return 0
        lengths = getattr(self, "lengths", None) or Lengths({}, self.model) if lengths is None else lengths
        return sum(map(lengths.__getitem__, PRE_TOKEN.findall(MARK + text.replace(" ", MARK))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.by_parts(text, self.lengths) if self.splits else len(self.model.encode(text))


def frequent_table(model) -> dict[str, int]:
    """Lengths of the vocabulary's whole-word pieces, at most one entry a piece."""
    words = [p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if len(p) > 1 and p[0] == MARK and MARK not in p[1:] and not model.is_unknown(model.piece_to_id(p))]
    return {w: len(ids) for w, ids in zip(words, model.encode([w[1:] for w in words]), strict=True)}


_KEPT: dict[str, Counter] = {}


def _counter(key: str, model_proto: bytes, frequent: dict[str, int]) -> Counter:
    """The counter of a model, kept with its cache for the tasks that follow in this worker."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Counter(model_proto, frequent)
    return _KEPT[key]


def count_column(text: Column, spark, model_path: str, limit: int = 4096) -> Column:
    """Struct (n_bytes, n_tokens, over_limit) of every whole text; the model file is read by the driver and broadcast."""
    bound_batches()
    import sentencepiece

    with open(model_path, "rb") as f:
        proto = f.read()
    frequent = frequent_table(sentencepiece.SentencePieceProcessor(model_proto=proto))
    shared = spark.sparkContext.broadcast((hashlib.sha256(proto).hexdigest(), proto, frequent))

    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(*shared.value)
        for texts in batches:
            tokens = [counter.count(t) for t in texts]
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    return count(text)
