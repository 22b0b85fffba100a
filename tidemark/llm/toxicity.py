"""Toxicity scores from a lexicon matched with Levenshtein automata.

A lexicon is learned from labelled documents: whole terms, and stems that open many different
words. It is kept as a trie. A word is matched by walking the trie and the Levenshtein automaton of
the word together: the automaton's state is one row of the edit-distance table, and a branch is
left as soon as no entry of that row is within the distance allowed and the word doesn't open with it. So
misspelled terms are found without listing their variants, and words with new endings by their stem. Every hit gets a context window: hits inside quotation marks or
after a reporting word count apart from direct ones. A logistic model over the counts of different words
that hit gives the score.

Defined results: a null or empty text has no hits and gets the score of the bias alone; the score of
equal texts is equal; very long texts are read whole. Extra columns are never read. A null id is in no
fold, so its row is not held out, and it has no label. With no labelled row of either class, the lexicon is
empty and the model keeps its prior weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import at_most_rows, bound_batches, crc_mod, hash_sample

WORD = re.compile(r"[^\W_](?:[\w@$!*]*[^\W_])?")
OPENING, CLOSING, SYMMETRIC = "“«„‹‘", "”»“›’", "\""
# Words that announce reported speech.
REPORTING = frozenset("said says wrote writes called quote quoted quotes citing cited dit écrit sagte schrieb dijo escribió".split())
FEATURES = ("exact", "exact_quoted", "fuzzy", "fuzzy_quoted", "stem", "stem_quoted")
PRIOR = np.array([-3.0, 4.0, 1.0, 1.5, 0.3, 3.0, 0.8])
CACHE_WORDS = 200_000
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")


def allowed(term: str) -> int:
    """Edits allowed for a term: none up to 4 characters, one up to 7, two beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Trie:
    """Lexicon trie; a node is (children, term ending here or None, whether it ends a stem)."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str]):
        self.root: list = [{}, None, False]
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        for word, stem in [*((t, False) for t in self.terms), *((s, True) for s in self.stems)]:
            node = self.root
            for ch in word:
                node = node[0].setdefault(ch, [{}, None, False])
            node[1], node[2] = word, stem
        self.exact = set(self.terms)
        self.max_edits = max((allowed(t) for t in self.terms), default=0)
        self.screens: dict[int, re.Pattern | None] = {}

    def _screen(self, n: int) -> re.Pattern | None:
        """A condition every match of length n meets: with d edits, one of d+1 parts of the term stands unchanged in the word, moved by d at most."""
        parts = [re.escape(s) for s in self.stems if len(s) <= n]
        for term in self.terms:
            d = allowed(term)
            if abs(len(term) - n) <= d:
                cuts = [len(term) * i // (d + 1) for i in range(d + 2)]
                parts += [f".{{{max(0, a - d)},{a + d}}}{re.escape(term[a:b])}" for a, b in zip(cuts, cuts[1:], strict=False)]
        return re.compile("|".join(parts), re.S) if parts else None

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """The nearest entry (entry, edits, is stem) within its allowance; ties go to the first in order."""
        if word in self.exact:
            return word, 0, False
        n, top = len(word), self.max_edits
        if n not in self.screens:
            self.screens[n] = self._screen(n)
        if (screen := self.screens[n]) is None or not screen.match(word):
            return None
        best: tuple[int, str, bool] | None = None
        stack = [(self.root, list(range(n + 1)), 0, True)]  # the last: the word opens with this node's path
        while stack:
            node, row, depth, opens = stack.pop()
            if node[1] is not None:
                if node[2]:
                    if opens:
                        best = min(best or (99, "", False), (0, node[1], True))
                elif row[n] <= allowed(node[1]):
                    best = min(best or (99, "", False), (row[n], node[1], False))
            for ch, child in node[0].items():
                left, new = depth + 1, [depth + 1]
                for i in range(1, n + 1):
                    left = min(left + 1, row[i] + 1, row[i - 1] + (word[i - 1] != ch))
                    new.append(left)
                on = opens and depth < n and word[depth] == ch
                if min(new) <= top or on:
                    stack.append((child, new, depth + 1, on))
        return None if best is None else (best[1], best[0], best[2])


@dataclass
class ToxicityModel:
    """Lexicon, words known to be harmless despite their nearness to a term, and logistic weights."""

    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    window: int = 8

    def __post_init__(self) -> None:
        self._trie: Trie | None = None
        self._cache: dict[str, tuple[str, int, bool] | None] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def look_up(self, word: str) -> tuple[str, int, bool] | None:
        if self._trie is None:
            self._trie = Trie(self.terms, self.stems)
        got = self._trie.match(word)
        if got is None and not word.isalpha() and (plain := word.translate(LOOKALIKES)) != word and plain in self._trie.exact:
            got = plain, sum(a != b for a, b in zip(word, plain, strict=True)), False
        return got

    def matches(self, words: Iterable[str]) -> dict[str, tuple[str, int, bool]]:
        """Those of the words that match and aren't harmless, through a cache of bounded size."""
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = {}
        for w in words:
            if w not in cache:
                cache[w] = self.look_up(w)
            if (got := cache[w]) is not None and not (got[1] and w in self.harmless):
                out[w] = got
        return out

    def hits(self, text: str) -> list[dict]:
        """Every hit of the text: span, term, edits, kind and whether its window marks a quotation."""
        low = text.lower()
        if len(low) != len(text):  # a character whose lower case is longer: keep offsets right
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = self.matches(set(WORD.findall(low)))
        if not found:
            return []
        spans = [m for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(found, key=len, reverse=True)))})", low)]
        out = []
        for m in spans:
            whole = WORD.match(low, m.start())
            if whole is None or whole[0] not in found or m.start() and (low[m.start() - 1].isalnum()):
                continue
            term, edits, stem = found[whole[0]]
            out.append({"start": m.start(), "end": whole.end(), "term": term, "edits": edits, "stem": stem, "quoted": self._quoted(low, m.start(), whole.end())})
        return out

    def _quoted(self, low: str, start: int, end: int) -> bool:
        """Whether the window around a hit shows an open quotation or a reporting word just before it."""
        before, after = low[max(0, start - 12 * self.window) : start], low[end : end + 12 * self.window]
        cut = max(before.rfind("\n"), -1)
        before = before[cut + 1 :]
        after = after.split("\n", 1)[0]
        if before.count(SYMMETRIC) % 2 == 1 and SYMMETRIC in after:
            return True
        for o, c in zip(OPENING, CLOSING, strict=True):
            if before.rfind(o) > before.rfind(c) and c in after:
                return True
        return not REPORTING.isdisjoint(before.split()[-self.window :]) and before.rstrip()[-1:] in ":,\"“«„"

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(FEATURES) + 1)
        x[0] = 1
        low = text.lower() if text else ""
        for _, stem, misspelt, quoted in {(low[h["start"] : h["end"]], h["stem"], h["edits"] > 0, h["quoted"]) for h in self.hits(text)} if text else ():
            x[1 + (4 if stem else 2 if misspelt else 0) + quoted] += 1
        x[1:] = np.log1p(x[1:])
        return x

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights))))))


def without_copies(texts: list[str], size: int = 5) -> list[str]:
    """The texts without those that share 2 of 4 min-hashes of their word shingles with an earlier one.

    A large group of copies would otherwise pass its own words off as a lexicon.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.lower().split()
        hashes = np.array([zlib.crc32(" ".join(words[i : i + size]).encode()) & 0x7FFFFFFF for i in range(max(1, len(words) - size + 1))], dtype=np.int64)
        keys = [(k, int(((hashes * m + 12345) % 2147483647).min())) for k, m in enumerate((1, 48271, 69621, 16807))]
        if sum(k in seen for k in keys) < 2:
            out.append(text)
        seen.update(keys)
    return out


def learn_lexicon(toxic: list[str], clean: list[str], min_share: float = 0.015, precision: float = 0.95, stem_precision: float = 0.8, stem_words: int = 8) -> tuple[list[str], list[str]]:
    """Stems that open many words of toxic documents, and terms, both by document.

    Every opening of 4 or more characters is counted. It is followed downwards while one continuation keeps 9
    of 10 of its documents. A stem opens ``stem_words`` different words and reaches the lower precision; the
    weights judge it. A term is a whole word that reaches the higher one and that no stem opens.
    """
    pos, neg, opens, whole = Counter(), Counter(), defaultdict(set), Counter()
    for texts, count in ((toxic, pos), (clean, neg)):
        for text in texts:
            words = {w for w in WORD.findall(text.lower()) if len(w) >= 4 and w.isalpha()}
            count.update({w[:k] for w in words for k in range(4, len(w) + 1)})
            if count is pos:
                whole.update(words)
                for w in words:
                    for k in range(4, min(len(w), 9) + 1):
                        opens[w[:k]].add(w)
    least = max(3, min_share * len(toxic))
    scale = len(clean) / max(1, len(toxic))
    share = {p: (n * scale) / (n * scale + neg[p] + 0.5) for p, n in pos.items() if n >= least}
    children = defaultdict(list)
    for p in pos:
        children[p[:-1]].append(p)

    def narrowed(p: str) -> str:
        while True:
            best = max(children[p], key=lambda c: (pos[c], c), default=None)
            if best is None or pos[best] < 0.9 * pos[p] or whole[p] >= 0.9 * pos[p]:
                return p
            p = best

    stems, terms = set(), set()
    for p in sorted((p for p, x in share.items() if x >= stem_precision), key=lambda p: (len(p), p)):
        if not any(p[:k] in stems for k in range(4, len(p))):
            p = narrowed(p)
            if share.get(p, 0) >= stem_precision and len(opens[p]) >= stem_words and whole[p] < 0.5 * pos[p]:
                stems.add(p)
    good = {p for p, x in share.items() if x >= precision and neg[p] * 20 <= pos[p]}
    for p in sorted(good, key=len):
        if p[:-1] not in good:
            p = narrowed(p)
            if whole[p] >= 0.5 * pos[p] and not any(p[:k] in stems for k in range(4, len(p) + 1)):
                terms.add(p)
    return sorted(terms), sorted(stems)


def fit(toxic: list[str], clean: list[str], rounds: int = 200) -> ToxicityModel:
    """Lexicon, harmless words and weights (logistic loss with a pull towards the prior weights).

    Few training rows have misspelt terms, so their prior weight comes from clean rows: the chance that a
    clean row has a near word not seen before is estimated by the near words seen once (Good-Turing). The
    smaller it is, the nearer a misspelt hit comes to the fitted weight of an exact one.
    """
    model = ToxicityModel(*learn_lexicon(without_copies(toxic), without_copies(clean)))
    near_pos, near_neg = Counter(), Counter()
    for texts, count in ((toxic, near_pos), (clean, near_neg)):
        for text in texts:
            count.update(w for w, (_, edits, _s) in model.matches(set(WORD.findall(text.lower()))).items() if edits)
    scale = len(clean) / max(1, len(toxic))
    model.harmless = frozenset(w for w, n in near_neg.items() if near_pos[w] * scale < 4 * n)
    x = np.array([model.features(t) for t in [*toxic, *clean]]).reshape(-1, len(PRIOR))
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    w = _logistic(x, y, PRIOR, rounds)
    unseen = (sum(n == 1 for n in near_neg.values()) + 0.5) / (len(clean) + 1)
    prior = w.copy()
    prior[3] = max(PRIOR[3], w[1] * math.log(1 / unseen) / math.log(2 * len(clean) + 2)) if len(clean) else PRIOR[3]
    model.weights = _logistic(x, y, prior, rounds)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int) -> np.ndarray:
    """Newton steps on the logistic loss with a ridge around the prior."""
    w = prior.copy()
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out_fold: int = 2, sample_per_class: int = 2500) -> ToxicityModel:
    """Fit on about ``sample_per_class`` labelled rows of each class, never from the held-out fold, and on four times as many in all at most.

    The sample is the documented bound: ids are picked by hash on the small label table, then their
    texts are fetched by a join with those few ids; the bound on rows also holds where an id repeats.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_out_fold)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).distinct()
    picked = None
    for y in (0, 1):
        part = hash_sample(known.where(F.col("__y") == y), "__id", sample_per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = at_most_rows(picked, 4 * sample_per_class, "__id", "__y")
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id").select("__id", "__y", "__text")
    rows = at_most_rows(found, 4 * sample_per_class, "__id", "__y", "__text").collect()
    rows.sort(key=lambda r: (r["__id"], r["__text"] or ""))
    return fit([r["__text"] or "" for r in rows if r["__y"] == 1], [r["__text"] or "" for r in rows if r["__y"] == 0])


def score_column(model: ToxicityModel, text: Column, spark) -> Column:
    """Score of every whole text, as a column; the model goes to the workers once, as a broadcast."""
    bound_batches()
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(text)
