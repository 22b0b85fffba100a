"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of the 64 gets a non-zero vector over GF(2) of ``radius + 1`` dimensions. Each
non-zero vector ``v`` of that space makes one mask: the positions whose vector has an odd product with
``v``. For any set of at most ``radius`` positions there is a ``v`` orthogonal to all of their vectors,
so two fingerprints that differ in these positions only agree under the mask of ``v``: every pair within
the radius collides in at least one of the ``2**(radius+1) - 1`` tables, with no chance involved.

Work is done on distinct fingerprints; copies are one node. Buckets are compared inside one task only
up to ``bucket_limit`` fingerprints. A larger bucket is dealt out again by the same construction on the
bits its mask leaves free, which again loses no pair, until it is small enough (distinct fingerprints
run out of free bits). A bucket gives a spanning forest of its links instead of all its pairs. Classes
are the connected components of the links, found by alternating large-star and small-star steps on
tables in the shared folder; nothing but counts reaches the driver.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like
any other; texts of fewer words than a shingle are one shingle; repeated rows come back as many times;
a row without an id links like any other, so it may bridge two classes, and its class is named by the
smallest id there is, or null if there is none; an empty table gives an empty result. Ids are of any type
that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches, materialise, remove, utf8_words

BITS = 64
SHINGLE = 3
SEED = 42
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = utf8_words(text) if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of every whole text as a signed long."""
    bound_batches()

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")

    return prints(text)


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are all left out by some mask."""
    space = 1 << (radius + 1)
    masks = []
    for v in range(1, space):
        masks.append(sum(1 << p for i, p in enumerate(positions) if (1 + i % (space - 1) & v).bit_count() % 2))
    return masks


def _forest(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest id of its class) for the classes of one bucket, compared in vectorised rows."""
    if len(ids) == 2:
        if (int(prints[0]) ^ int(prints[1])).bit_count() <= radius:
            return [(int(max(ids)), int(min(ids)))]
        return []
    order = np.argsort(ids, kind="stable")
    ids, prints = ids[order], prints[order]
    left = np.ones(len(ids), dtype=bool)
    out = []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(prints[front[at : at + 256], None] ^ prints[None, rest]) <= radius).any(axis=0)
            front = rest[near]
            left[front] = False
            out += [(int(ids[i]), int(ids[root])) for i in front]
    return out


EDGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _edges_column(ids: Column, prints: Column, radius: int) -> Column:
    @F.pandas_udf(EDGES)
    def edges(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for many_ids, many_prints in batches:
            yield pd.Series([_forest(np.asarray(i, dtype=np.int64), np.asarray(p, dtype=np.int64).view(np.uint64), radius) for i, p in zip(many_ids, many_prints, strict=True)], dtype=object)

    return edges(ids, prints)


@lru_cache(maxsize=1 << 14)
def finer_masks(mask: int, radius: int) -> tuple[int, ...]:
    """Masks that add to a mask a covering of the bits it leaves free."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    return tuple(mask | s for s in covering_masks(free, radius)) if len(free) > radius else ((1 << BITS) - 1,)


def _finer_column(mask: Column, radius: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def finer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for masks in batches:
            yield pd.Series([[signed(m) for m in dict.fromkeys(finer_masks(x & (1 << BITS) - 1, radius))] for x in masks.tolist()], dtype=object)

    return finer(mask)


def candidate_edges(nodes: DataFrame, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """Edges (a, b) that connect every pair of nodes (nid, fp) within the radius; fp values are distinct."""
    masks = F.array(*[F.lit(signed(m)) for m in covering_masks(list(range(BITS)), radius)])
    level = nodes.select("nid", "fp", F.explode(masks).alias("mask"))
    found = None
    for _ in range(BITS):
        keyed = level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        small = keyed.join(sizes.where(F.col("n") <= bucket_limit), ["mask", "key"])
        lists = small.groupBy("mask", "key").agg(F.collect_list(F.struct("nid", "fp")).alias("m"))
        edges = lists.select(F.explode(_edges_column(F.col("m.nid"), F.col("m.fp"), radius)).alias("e")).select("e.a", "e.b")
        found = edges if found is None else found.unionByName(edges)
        hot = sizes.where(F.col("n") > bucket_limit)
        if hot.isEmpty():
            return found
        level, _ = materialise(keyed.join(hot, ["mask", "key"]).select("nid", "fp", F.explode(_finer_column(F.col("mask"), radius)).alias("mask")).distinct(), "finer")
    raise AssertionError("distinct fingerprints share every bit")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it can reach.

    Alternating large-star and small-star steps; each round's edges are a table in the shared folder, and
    rounds end when neither count nor checksum of the edges changes. The number of rounds grows with the
    logarithm of the longest chain; edges that still change after ``max_rounds`` raise an error.
    """
    spark = edges.sparkSession
    now, path = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new, new_path = materialise(small, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = new, new_path
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"the components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """doc_id, fp (signed long), component_id and component for every row: classes of fingerprints within ``radius`` bits.

    ``component`` names the class by its smallest fingerprint, also where no row of it has an id.
    """
    prints, _ = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(candidate_edges(nodes.select(F.col("fp").alias("nid"), "fp"), radius, bucket_limit))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id", "component")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "component")
