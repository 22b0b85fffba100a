"""Language identification with Viterbi spans over word scores.

The scripts of a text's letters narrow the candidate languages. Each word then has a log-score per
candidate (whole-word counts backed off to letter trigrams), and a Viterbi pass with a penalty for
every switch of language labels spans of mixed text. A document's language is the one whose spans
hold the most letters of words that tell languages apart.

Defined results: a null text, or one with no letter, is ``und`` with score 0, and so is every text if no
language was learned; ties go to the first language in code-point order. Words of a script that no
learned language uses are in ``und`` spans. A text with letters always gets a learned language: where no
word tells languages apart, that of its longest spans (the first language, if it has none) with score 0.
A null id is in no fold, so its row is not held out, and is not learned from. Texts are read whole at any
length. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import at_most_rows, bound_batches, crc_mod, hash_sample

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
CACHE_WORDS = 250_000
ALPHABET = 96  # commonest letters of the training texts, with a number each
RARE = 30  # numbers that all other letters share by a hash of the code point
SIDE = ALPHABET + RARE + 2  # 0 stands for signs that are no letters, 1 for a word's edge
# First and last code point of the main blocks of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


SCRIPT_NAMES = [*SCRIPTS, "other"]


def script_table() -> np.ndarray:
    """Number of the script of every code point of the first two planes."""
    out = np.full(0x20000, len(SCRIPT_NAMES) - 1, dtype=np.uint8)
    for i, spans in enumerate(SCRIPTS.values()):
        for first, last in spans:
            out[first : last + 1] = i
    return out


SCRIPT_OF = script_table()


def code_points(words: list[str]) -> np.ndarray:
    """Code points of the words with a zero before, between and after them."""
    joined = "\0" + "\0".join(words) + "\0"
    return np.minimum(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), len(SCRIPT_OF) - 1)


def trigrams(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Numbers of the letter trigrams around every letter, edges included."""
    ids = letters[codes].astype(np.int64)
    return (ids[:-2] * SIDE + ids[1:-1]) * SIDE + ids[2:]


@dataclass
class LanguageModel:
    """Log-probabilities of words and n-grams by language, and the scripts each language uses."""

    langs: list[str]
    letters: np.ndarray  # letter number of every code point
    gram_row: np.ndarray  # row of every trigram in logp; row 0: never learned
    logp: np.ndarray
    word_id: dict[str, int]
    uses: np.ndarray  # script by language: whether the language uses it
    switch_penalty: float = 6.0
    clip: float = 8.0
    _index: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_index": {}, "_table": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of words by language relative to the best (zeros where no language uses the script)."""
        codes = code_points(words)
        rows = self.gram_row[trigrams(codes, self.letters)]
        inside = np.flatnonzero(codes[1:-1])
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        score = np.add.reduceat(self.logp[rows[inside]], starts, axis=0) / np.sqrt(sizes)[:, None]
        for i, w in enumerate(words):
            if (at := self.word_id.get(w)) is not None:
                score[i] = self.logp[at]
        usable = self.uses[SCRIPT_OF[codes[1:-1][inside][starts]]]
        score = score - np.where(usable, score, -np.inf).max(axis=1, keepdims=True, initial=-1e9)
        score = np.where(usable, np.maximum(score, -self.clip), -1e6)
        score[~usable.any(axis=1)] = 0
        return score

    def usable(self, words: list[str]) -> np.ndarray:
        """Whether some language uses the script that each word starts with."""
        firsts = np.fromiter((min(ord(w[0]), len(SCRIPT_OF) - 1) for w in words), dtype=np.int64, count=len(words))
        return self.uses[SCRIPT_OF[firsts]].any(axis=1)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Row of the score table for every word (0: no candidate language), through a cache of bounded size."""
        if self._table is None or len(self._index) > CACHE_WORDS:
            self._index, self._table = {}, np.zeros((1024, len(self.langs)))
        index = self._index
        new = list(set(words).difference(index))
        if new:
            score, first = self.scores(new), len(index) + 1
            last = first + len(new)
            if last > len(self._table):
                self._table = np.concatenate([self._table, np.zeros((max(len(self._table), last - len(self._table)), len(self.langs)))])
            self._table[first:last] = score
            index.update(zip(new, np.where(self.usable(new), np.arange(first, last), 0).tolist(), strict=True))
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, words: list[str]) -> np.ndarray:
        """Viterbi path: the language of every word (-1 where no candidate is left)."""
        return self._path(self.rows_of(words))

    def _path(self, at: np.ndarray) -> np.ndarray:
        """Viterbi path over rows of the score table.

        The constant path of the best single language is optimal, and the dynamic programme is not run, where
        no stretch of words gains more than half a switch in another language. A path with k runs of other
        languages has k - 1 switches or more; with one it is no better than the constant path, or has a switch,
        and with k >= 2 it gains at most k/2 switches, which is not more than k - 1.
        """
        if not at.any():
            return np.full(len(at), -1)
        table = self._table[at]
        best = int(table.sum(axis=0).argmax())
        gain = np.cumsum(table - table[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, len(self.langs))), gain]), axis=0)[:-1]
        path = np.full(len(at), best) if (gain - low).max() <= self.switch_penalty / 2 else self._viterbi(table)
        path[at == 0] = -1
        return path

    def _viterbi(self, table: np.ndarray) -> np.ndarray:
        own = list(range(table.shape[1]))
        back = np.empty(table.shape, dtype=np.int16)
        now = table[0].tolist()
        for i, row in enumerate(table[1:].tolist(), 1):
            top = max(now)
            at, enter = now.index(top), top - self.switch_penalty
            back[i] = [j if now[j] >= enter else at for j in own]
            now = [(x if x >= enter else enter) + y for x, y in zip(now, row, strict=True)]
        path = np.empty(len(table), dtype=np.int64)
        state = now.index(max(now))
        for i in range(len(table) - 1, -1, -1):
            path[i] = state
            state = int(back[i, state])
        return path

    def spans(self, text: str | None) -> list[dict]:
        """Spans of one language each, with offsets in the text."""
        found = list(LETTERS.finditer(text or ""))
        path = self.label([m[0].lower() for m in found]) if found and self.langs else [-1] * len(found)
        out: list[dict] = []
        for m, state in zip(found, path, strict=True):
            lang = self.langs[state] if state >= 0 else UNDETERMINED
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = m.end()
                out[-1]["words"] += 1
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": lang, "words": 1})
        return out

    def describe(self, text: str | None) -> tuple[str, float, float]:
        """The language with most letters in words that tell languages apart, their share of all letters, and the share of letters in words of any language's script."""
        words = LETTERS.findall(text.lower()) if text else []
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNDETERMINED, 0.0, 0.0
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = self.rows_of(words)
        path, known = self._path(at), float(size[at > 0].sum() / size.sum())
        told = np.where(self._table[at].any(axis=1) | (len(self.langs) == 1), size, 0)
        held = np.bincount(path + 1, weights=told, minlength=len(self.langs) + 1)[1:]
        if held.any():
            best = int(held.argmax())
            return self.langs[best], float(held[best] / size.sum()), known
        return self.langs[int(np.bincount(path + 1, weights=size, minlength=len(self.langs) + 1)[1:].argmax())], 0.0, known

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its share of the letters."""
        return self.describe(text)[:2]


def fit(rows: list[tuple[str, str]], min_count: int = 2, frequent: int = 20) -> LanguageModel:
    """Model from (text, language) rows; counts are smoothed by language."""
    langs = sorted({lang for _, lang in rows})
    counts = [Counter() for _ in langs]
    for text, lang in rows:
        counts[langs.index(lang)].update(LETTERS.findall(text.lower()))
    held = Counter()
    for c in counts:
        for w, n in c.items():
            for ch in set(w):
                held[ch] += n
    letters = (2 + ALPHABET + (np.arange(len(SCRIPT_OF)) * 2654435761 >> 16) % RARE).astype(np.uint8)
    letters[0] = 1
    for i, ch in enumerate(sorted(held, key=lambda ch: (-held[ch], ch))[:ALPHABET]):
        letters[min(ord(ch), len(letters) - 1)] = i + 2
    grams, scripts = np.zeros((len(langs), SIDE**3)), np.zeros((len(langs), len(SCRIPT_NAMES)))
    for i, c in enumerate(counts):
        words = sorted(c)
        if not words:
            continue
        codes = code_points(words)
        inside = np.flatnonzero(codes[1:-1])
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        times = np.fromiter((c[w] for w in words), dtype=np.int64, count=len(words))
        grams[i] = np.bincount(trigrams(codes, letters)[inside], weights=np.repeat(times, sizes), minlength=SIDE**3)
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scripts[i] = np.bincount(SCRIPT_OF[codes[1:-1][inside][firsts]], weights=times, minlength=len(SCRIPT_NAMES))
    kept = np.flatnonzero(grams.sum(axis=0) >= min_count)
    totals = np.maximum(1, grams.sum(axis=1))
    logp = [np.full((1, len(langs)), np.log(0.5 / (totals + 0.5 * max(1, len(kept)))).mean() if langs else 0.0)]
    logp.append(np.log((grams[:, kept].T + 0.5) / (totals + 0.5 * max(1, len(kept)))))
    gram_row = np.zeros(SIDE**3, dtype=np.int32)
    gram_row[kept] = np.arange(1, len(kept) + 1)
    every = Counter()
    for c in counts:
        every.update(c)
    words = sorted(w for w, n in every.items() if n >= frequent)
    word_totals = np.array([max(1, sum(c.values())) for c in counts], dtype=float)
    logp.append(np.log((np.array([[c[w] for c in counts] for w in words]).reshape(len(words), len(langs)) + 0.5) / (word_totals + 0.5 * len(every))))
    uses = (scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))).T > 0.01
    return LanguageModel(langs, letters, gram_row, np.concatenate(logp), {w: 1 + len(kept) + i for i, w in enumerate(words)}, uses)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out_fold: int = 1, sample_rows: int = 3000) -> LanguageModel:
    """Fit on about ``sample_rows`` rows with a language, never from the held-out fold, and on twice as many at most.

    The bound is documented and does not depend on the size of the table, nor on how often an id repeats.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_out_fold))
    texts = known.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    picked = hash_sample(texts, "__id", sample_rows, total=known.select(id_col, lang_col).count()).where(F.col("__text").isNotNull())
    rows = at_most_rows(picked, 2 * sample_rows, "__id", "__lang", "__text").collect()
    rows.sort(key=lambda r: (r["__id"], r["__lang"], r["__text"]))
    return fit([(r["__text"], r["__lang"]) for r in rows])


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])


def predict_column(model: LanguageModel, text: Column, spark) -> Column:
    """Struct (lang_pred, score, known) of every whole text, as a column; see :meth:`LanguageModel.describe`."""
    bound_batches()
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.describe(t) for t in texts], columns=PREDICTION.names)

    return predict(text)
