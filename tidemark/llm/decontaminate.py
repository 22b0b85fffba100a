"""Benchmark decontamination with one Aho-Corasick automaton over words.

Texts are normalised the same way: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
``window`` consecutive words of a benchmark item; a shorter item is one window. The automaton works on word
numbers. To keep it small it holds, instead of every window, the pieces that items are cut into: of length
``(window + 1) // 2`` and side by side, so that each window holds a whole piece. A text is scanned once; where a piece is found, the
windows that may lie around it there are looked up in a table of all windows. Hits are word positions,
which map back to the spans of the original text.

The automaton is built once in each worker from a broadcast of the items, whose size is checked: a
benchmark of more than ``max_pattern_words`` words is dealt out to several automata, each of which is
run over all documents; their hits are merged by document. The driver holds one such part at a time. A worker
keeps its automata for the tasks that follow, up to ``KEPT_WORDS`` words in all, and builds what is beyond that
again.

Defined results: null and empty texts have no words and no hits; items without words match nothing;
repeated items count once by id; a null item id is left out of the list of items but its windows still
hit; documents come back as often as they are given. Whole texts are scanned at any length.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches

MAX_PATTERN_WORDS = 250_000  # some 120 MB in a worker
KEPT_WORDS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    """A-Z lower-cased and nothing else; the length doesn't change."""
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


class Matcher:
    """The automaton of some items: (item id as text, words)."""

    def __init__(self, items: Iterable[tuple[str | None, list[str]]], window: int):
        import ahocorasick

        self.window, self.piece = window, (window + 1) // 2
        self.number: dict[str, int] = {}
        self.words = 0
        owners: dict[tuple[int, ...], set[str | None] | str | None] = {}
        pieces: set[tuple[int, ...]] = set()
        for item, words in items:
            self.words += len(words)
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            if not ids:
                continue
            if len(ids) < window:
                pieces.add(ids)
            else:
                pieces.update(ids[i : i + self.piece] for i in range(0, len(ids) - self.piece + 1, self.piece))
            for i in range(max(1, len(ids) - window + 1)):
                key = ids[i : i + window]
                owners.setdefault(self._packed(key), set()).add(item)
        kinds: dict[frozenset, frozenset] = {}
        self.owners = {k: kinds.setdefault(f := frozenset(v), f) for k, v in owners.items()}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p in pieces:  # a short item is a window itself; one as long as a piece may be both
            own = self.owners.get(self._packed(p)) if len(p) < window else None
            self.auto.add_word(p, (len(p), own))
        self.empty = not pieces
        if not self.empty:
            self.auto.make_automaton()

    @staticmethod
    def _packed(ids: tuple[int, ...]) -> bytes:
        return array("I", ids).tobytes()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged runs [from, to) of hit words, and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        ids = tuple(map(self.number.get, words, repeat(0)))
        window, piece = self.window, self.piece
        hits: list[tuple[int, int]] = []
        items: set[str | None] = set()
        raw, seen = None, -1  # windows that start up to ``seen`` are looked up
        for end, (n, own) in self.auto.iter(ids):
            if own is not None:
                hits.append((end - n + 1, end + 1))
                items |= own
            if n == piece:
                raw = array("I", ids).tobytes() if raw is None else raw
                first = end - n + 1
                for i in range(max(0, first - window + piece, seen + 1), min(first, len(ids) - window) + 1):
                    if (found := self.owners.get(raw[4 * i : 4 * (i + window)])) is not None:
                        hits.append((i, i + window))
                        items |= found
                seen = max(seen, first)
        hits.sort()
        runs: list[tuple[int, int]] = []
        for a, b in hits:
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return runs, items


SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
_BUILT: dict[str, Matcher] = {}


def _matcher(key: str, items: list, window: int) -> Matcher:
    """The automaton of a broadcast, built once in a worker while there is room; the key names the broadcast among all that a worker sees."""
    found = _BUILT.pop(key, None)
    if found is None:
        size = sum(len(words) for _, words in items)
        while _BUILT and size + sum(m.words for m in _BUILT.values()) > KEPT_WORDS:
            del _BUILT[next(iter(_BUILT))]
        found = Matcher(items, window)
    _BUILT[key] = found  # the last used comes last
    return found


def scan_column(items: list[tuple[str | None, list[str]]], text: Column, spark, window: int) -> Column:
    """Struct (n_words, runs of hit words, items) of every text against one automaton."""
    bound_batches()
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(*shared.value, window)
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                runs, found = matcher.scan(words)
                out.append((len(words), [list(r) for r in runs], sorted(i for i in found if i is not None)))
            yield pd.DataFrame(out, columns=SCAN.names)

    return scan(text)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_pattern_words: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The benchmark's items in parts of a bounded number of words, read row by row; one part at least, which may be empty."""
    block: list = []
    held, given = 0, False
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if block and held + len(words) > max_pattern_words:
            yield block
            block, held, given = [], 0, True
        block.append((row["i"], words))
        held += len(words)
    if block or not given:
        yield block


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), ",").cast("binary"), 256)


def _merge(runs: Column) -> Column:
    """Words covered by runs [from, to) that are sorted by their start: a sweep over the array."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], acc["end"]))).alias("n"), F.greatest(acc["end"], r[1]).alias("end"))

    return F.aggregate(runs, zero, step, lambda acc: acc["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_pattern_words: int = MAX_PATTERN_WORDS,
) -> DataFrame:
    """Adds ``__tm_scan`` (n_words, runs, items) and ``__tm_hit`` to every row of ``docs``; other columns pass through.

    Every row keeps its hits so far; each part of the benchmark is one more scan of the same text.
    """
    out = docs
    for i, block in enumerate(item_blocks(benchmark, item_col, item_text_col, max_pattern_words)):
        scanned = scan_column(block, F.col(text_col), docs.sparkSession, window)
        if not i:
            out = out.withColumn("__tm_scan", scanned)
            continue
        merged = F.struct(
            F.col("__tm_scan.n_words").alias("n_words"),
            F.array_sort(F.concat("__tm_scan.runs", "__tm_more.runs")).alias("runs"),
            F.array_union("__tm_scan.items", "__tm_more.items").alias("items"),
        )
        out = out.withColumn("__tm_more", scanned).withColumn("__tm_scan", merged).drop("__tm_more")
    return out.withColumn("__tm_hit", _merge(F.col("__tm_scan.runs")))


def contaminated(hit: Column, words: Column) -> Column:
    """The contamination rule: some hit, and at least a twentieth of the words."""
    return (hit > 0) & (hit * 20 >= words)


def original_spans(text: str, runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans, in the original text, of runs of words."""
    at = [m.span() for m in WORD.finditer(ascii_lower(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]

