"""Mixing sources to target weights with packed blocks and pseudorandom permutations.

Every source's words are packed, in an order given by a hash of the id, into blocks of fixed length. The
mix is a row of output shards with a fixed number of slots. For every shard a multinomial draw gives the
slots of each source. The draws are conditioned on the whole mix: halving the shards again and again,
each half's counts are drawn without replacement from what its parent has, by a generator seeded with
the node, so any shard's counts and slot numbers follow without the other shards, reruns agree, and the
totals are the targets. Slot ``j`` of a source stands for position ``j mod n`` of pass ``j div n`` through
its ``n`` blocks, mapped by a Feistel permutation of that pass; blocks are then joined by index. A last
block that isn't full ends every pass, and a source's last slot takes only as many words as its target still
lacks, so a source's words are its target rounded. No block is used more often than there are passes,
whose number is the cap rounded up; the words of a source never exceed the cap itself.

Offsets of rows in their source come from sums over hash bins, added up level by level, so no task ever
holds a whole source; rows that are alike in source, id and size are one row with a count there. Only the list
of sources (checked against ``max_sources`` before it is collected) reaches the driver.

Defined results: null and empty texts have size 0 and are never taken; null is a source of its own and
comes last; a source without words has target 0; repeated rows are packed as often as they occur; an
empty table gives an empty mix.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
LIBRARY_LIMIT = 900_000_000  # the library's hypergeometric draws hold less than a billion items


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes; none above ``cap`` times its size, the excess reshared by weight."""
    left, targets, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = cap * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` items drawn without replacement are good, exactly at any size.

    Give every item a uniform key and take the smallest. The key of the middle good item is a Beta draw, and a
    Binomial draw says how many bad keys lie below it; that settles one side, and the other is a smaller draw
    of the same kind.
    """
    found = 0
    while good and take:
        if good + bad < LIBRARY_LIMIT:
            return found + int(rng.hypergeometric(good, bad, take))
        middle = (good + 1) // 2
        below = int(rng.binomial(bad, rng.beta(middle, good - middle + 1))) if bad else 0
        if middle + below <= take:
            found, take = found + middle, take - middle - below
            good, bad = good - middle, bad - below
        else:
            good, bad = middle - 1, below
    return found


@dataclass(frozen=True)
class MixPlan:
    """What fixes a mix: blocks and slots by source, words of each source's last slot, slots by shard, the seed."""

    blocks: tuple[int, ...]
    quotas: tuple[int, ...]
    last: tuple[int, ...]
    slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-sum(self.quotas) // self.slots)

    def counts(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For the shards [first, last): shard, its sources, slots of each, and how many of these come in earlier shards.

        Nodes above several shards are drawn once; sources that a node has no slots of are left out below it.
        """
        have = np.array(self.quotas, dtype=np.int64)
        sids = np.flatnonzero(have)
        stack = [(0, self.shards, sids, have[sids], np.zeros(len(sids), dtype=np.int64))]
        while stack:
            low, high, sids, have, before = stack.pop()
            if high <= first or low >= last or low >= high:
                continue
            if high - low == 1:
                yield low, sids, have, before
                continue
            middle = (low + high) // 2
            left = self._draw(have, min((middle - low) * self.slots, int(have.sum())), (self.seed, low, high))
            for a, b, n, seen in ((middle, high, have - left, before + left), (low, middle, left, before)):
                some = n > 0
                stack.append((a, b, sids[some], n[some], seen[some]))

    @staticmethod
    def _draw(have: np.ndarray, take: int, node: tuple[int, ...]) -> np.ndarray:
        rng = np.random.default_rng(node)
        if have.sum() < LIBRARY_LIMIT:
            return rng.multivariate_hypergeometric(have, take, method="marginals")
        out, rest = np.zeros_like(have), int(have.sum())
        for i, n in enumerate(have.tolist()):
            rest -= n
            out[i] = hypergeometric(rng, n, rest, take)
            take -= int(out[i])
        return out


def quota_of(size: int, target: float, block: int, cap: float) -> tuple[int, int]:
    """Slots of a source, and words of the last one, that together take its target rounded and never over the cap."""
    words = min(round(target), math.floor(Fraction(str(cap)) * size))
    if words <= 0:
        return 0, 0
    turns, rest = divmod(words, size)
    blocks = -(-size // block)
    part = -(-rest // block)
    return turns * blocks + part, rest - (part - 1) * block if part else block


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at x: four Feistel rounds, walked until the value is inside."""
    if n <= 1:
        return np.zeros_like(x)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(0, 1 << 63, size=4, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for r in rounds:
            f = (b + r) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (f >> np.uint64(32) & low)
        return a << np.uint64(half) | b

    with np.errstate(over="ignore"):
        out = once(x.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "slot", "sid", "pass", "block", "words")])


def slots(spark: SparkSession, plan: MixPlan, block: int, task_slots: int = 50_000) -> DataFrame:
    """One row for each slot of the mix: shard, slot, source index, pass, block and how many of its words are taken.

    A task has a range of shards, of about ``task_slots`` slots in all, or more where that would make over 20,000 tasks.
    """
    parts = max(1, min(plan.shards, 20_000, 1 + sum(plan.quotas) // task_slots))

    def shard_slots(shard: int, sids: np.ndarray, n: np.ndarray, before: np.ndarray, blocks: np.ndarray, quotas: np.ndarray, last: np.ndarray) -> np.ndarray:
        sid = np.repeat(sids, n)
        j = np.concatenate([b + np.arange(k) for b, k in zip(before, n, strict=True)])
        turn, at = j // blocks[sid], j % blocks[sid]
        place = np.empty_like(at)
        for s, t in {*zip(sid.tolist(), turn.tolist(), strict=True)}:
            here = (sid == s) & (turn == t)
            place[here] = position(at[here], int(blocks[s]), plan.seed * 1_000_003 + s * 1009 + t)
        words = np.where(j == quotas[sid] - 1, last[sid], block)
        order = np.random.default_rng((plan.seed, shard, 7)).permutation(len(sid))
        return np.stack([np.full(len(sid), shard), np.arange(len(sid)), sid[order], turn[order], place[order], words[order]])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = [np.array(x, dtype=np.int64) for x in (plan.blocks, plan.quotas, plan.last)]
        for batch in batches:
            for task in batch["id"]:
                shards = plan.counts(plan.shards * task // parts, plan.shards * (task + 1) // parts)
                while some := list(itertools.islice(shards, 32)):
                    yield pd.DataFrame(np.concatenate([shard_slots(*x, *fixed) for x in some], axis=1).T, columns=SLOTS.names)

    return spark.range(0, parts, 1, parts).mapInPandas(draw, SLOTS) if plan.shards else spark.createDataFrame([], SLOTS)


def position(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Block at place x of a pass through n blocks: a permutation of all but the last, which may not be full and ends the pass."""
    return np.where(x == n - 1, x, permute(np.minimum(x, max(0, n - 2)), n - 1, key))


def offsets(rows: DataFrame, total_rows: int, bin_rows: int = 256, fan: int = 1024) -> DataFrame:
    """Adds ``start``: words of the row's source that come before it, in the order of a hash of its id.

    Rows fall into hash bins by source; a bin is ordered in one task, bins' sums are added up level by
    level, at most ``fan`` of them at a time. Rows alike in all of (doc_id, sid, size) are counted before
    they are ordered, and stand one after another.
    """
    from pyspark.sql import Window

    bins = max(1, -(-total_rows // bin_rows))
    distinct = rows.groupBy("doc_id", "sid", "size").agg(F.count(F.lit(1)).alias("copies"))
    binned = distinct.withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(bins)))
    within = Window.partitionBy("sid", "bin").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    all_words = F.col("size") * F.col("copies")
    levels = [binned.groupBy("sid", "bin").agg(F.sum(all_words).alias("sum"))]
    width = bins
    while width > fan:
        levels.append(levels[-1].groupBy("sid", F.expr(f"bin div {fan}").alias("bin")).agg(F.sum("sum").alias("sum")))
        width = -(-width // fan)
    base = None
    for level in reversed(levels):
        up = Window.partitionBy("sid", F.expr(f"bin div {fan}")).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        own = level.select("sid", "bin", F.coalesce(F.sum("sum").over(up), F.lit(0)).alias("own"))
        if base is not None:
            base = base.select("sid", F.col("bin").alias("up"), "base")
            own = own.withColumn("up", F.expr(f"bin div {fan}")).join(base, ["sid", "up"]).select("sid", "bin", (F.col("own") + F.col("base")).alias("base"))
        else:
            own = own.withColumnRenamed("own", "base")
        base = own
    inner = F.coalesce(F.sum(all_words).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = binned.withColumn("inner", inner).withColumn("nr", F.row_number().over(within))
    placed = ranked.join(base, ["sid", "bin"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("base") + F.col("inner") + F.col("copy") * F.col("size")
    return placed.withColumn("start", start).drop("base", "inner", "copies")


@dataclass
class Mix:
    """``sources`` (name, size, target by index), ``rows`` (doc_id, sid, size, start, bin, nr, copy) and ``slots`` of a mix."""

    sources: list[tuple[str | None, int, float]]
    rows: DataFrame
    slots: DataFrame
    plan: MixPlan
    block: int

    def spans(self) -> DataFrame:
        """One row for each piece of a document in a block: sid, block, doc_id, its words [word_from, word_to) and where in the block they begin."""
        size, end = self.block, F.expr("start + size")
        covered = F.expr(f"sequence(start div {size}, (start + size - 1) div {size})")
        pieces = self.rows.where("size > 0").withColumn("block", F.explode(covered))
        first, stop = F.greatest(F.col("start"), F.col("block") * size), F.least(end, (F.col("block") + 1) * size)
        word_from, word_to = (first - F.col("start")).alias("word_from"), (stop - F.col("start")).alias("word_to")
        return pieces.select("sid", "block", "doc_id", "bin", "nr", "copy", "size", "start", word_from, word_to, (first - F.col("block") * size).alias("at"))

    def mixed(self) -> DataFrame:
        """The mix: shard, slot, source index, block, doc_id and word span of every piece."""
        pieces = self.slots.hint("merge").join(self.spans(), ["sid", "block"]).where("at < words")
        word_to = F.least(F.col("word_to"), F.col("word_from") + F.col("words") - F.col("at")).alias("word_to")
        return pieces.select("shard", "slot", "sid", "block", "doc_id", "start", "word_from", word_to)

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and words taken, for every row."""
        part = F.when(F.col("words") < self.block, F.col("words"))
        used = self.slots.groupBy("sid", "block").agg(F.count_if(part.isNull()).alias("times"), F.coalesce(F.max(part), F.lit(0)).alias("part"))
        used = used.hint("merge")  # else the planner takes the slots for as small as the range they come from, and broadcasts them
        length = F.col("word_to") - F.col("word_from")
        words = length * F.col("times") + F.greatest(F.lit(0), F.least(length, F.col("part") - F.col("at")))
        taken = self.spans().join(used, ["sid", "block"]).groupBy("sid", "bin", "nr", "copy").agg(F.sum(words).alias("taken"))
        spark = self.rows.sparkSession
        totals = spark.createDataFrame([(i, int(n), float(t)) for i, (_, n, t) in enumerate(self.sources)], "sid long, source_size long, target double")
        every = self.rows.join(taken, ["sid", "bin", "nr", "copy"], "left").join(F.broadcast(totals), "sid")
        return every.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = 256,
    shard_slots: int = 512,
    seed: int = 11,
    share: float = 1.5,
    cap: float = 2.0,
    max_sources: int = 500_000,
) -> Mix:
    """Pack, draw and map; see the module's text. Blocks hold ``block`` words, the last of a source fewer.

    The driver and each task hold three numbers a source, and the list of names is broadcast: ``max_sources`` bounds that, and more
    sources are refused before any is collected.
    """
    spark = docs.sparkSession
    sized, _ = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    by_source, _ = materialise(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "sources")
    if by_source.count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(by_source.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    targets = water_fill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], share, cap)
    quotas = [quota_of(n, t, block, cap) for n, t in zip(sizes, targets, strict=True)]
    plan = MixPlan(tuple(max(1, -(-n // block)) for n in sizes), tuple(q for q, _ in quotas), tuple(w for _, w in quotas), shard_slots, seed)
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], "name string, sid long")
    rows = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "sid", "size")
    placed = offsets(rows, sum(r["n"] for r in found))
    return Mix([(r["source"], n, t) for r, n, t in zip(found, sizes, targets, strict=True)], placed, slots(spark, plan, block), plan, block)


def materialise_blocks(m: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of the mix: shard, slot and the words of its block, joined by single spaces. Needs ids that don't repeat."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORDS})"), 1)
    pieces = m.mixed().join(docs.select(F.col(id_col).alias("doc_id"), words.alias("words")), "doc_id")
    own = F.slice("words", F.col("word_from").cast("int") + 1, (F.col("word_to") - F.col("word_from")).cast("int"))
    piece = F.struct((F.col("start") + F.col("word_from")).alias("at"), F.array_join(own, " ").alias("text"))
    text = F.array_join(F.sort_array(F.collect_list(piece)).getField("text"), " ")
    return pieces.groupBy("shard", "slot", "sid", "block").agg(text.alias("text"))
