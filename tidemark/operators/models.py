"""Learned operators: clustering, implicit ALS, graph training, resampling, cross-validation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.recommend import encode_ids


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where it is zero)."""
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    wide = df.crossJoin(F.broadcast(row))
    unit = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return wide.select(*[((F.col(c) - F.col(f"__m_{c}")) / unit(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Median for missing numbers, most frequent value (ties: smallest) for missing categories."""
    row = df.agg(*[F.median(c).alias(f"__f_{c}") for c in numeric])
    out = df.crossJoin(F.broadcast(row)) if numeric else df
    for c in categorical:
        mode = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c)).limit(1).select(F.col(c).alias(f"__f_{c}"))
        out = out.join(F.broadcast(mode), F.lit(True), "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__f_{c}")).alias(c) if c in {*numeric, *categorical} else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each known value; an unknown value has none."""
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in values])


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="__features").transform(df)


SUMS = T.StructType(
    [
        T.StructField("model", T.IntegerType()),
        T.StructField("centre", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("sums", T.ArrayType(T.DoubleType())),
    ]
)
APART = T.StructType([T.StructField(n, t) for n, t in (("model", T.IntegerType()), ("centre", T.IntegerType()), ("query", T.IntegerType()), ("n", T.LongType()), ("total", T.DoubleType()))])


@dataclass(frozen=True)
class Clustering:
    """Centres, sorted so that equal ones give equal ids, with sizes and the sum of squared distances."""

    centres: np.ndarray
    sizes: np.ndarray
    inertia: float


def _points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Start centres, each drawn with a chance in proportion to its squared distance from those before."""
    centres = [x[rng.integers(len(x))]]
    near = _square_distances(x, centres[0][None])[:, 0]
    while len(centres) < k:
        total = near.sum()
        centres.append(x[rng.choice(len(x), p=near / total)] if total > 0 else x[rng.integers(len(x))])
        near = np.minimum(near, _square_distances(x, centres[-1][None])[:, 0])
    return np.array(centres)


def _one_pass(points: DataFrame, models: dict[int, np.ndarray], dims: int) -> dict[int, list]:
    """Sizes, sums and costs by centre of all models, from one pass over the points."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {m: [np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)] for m, c in models.items()}
        stacked = np.concatenate(list(models.values()))
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), dims)
            far, at = _square_distances(x, stacked), 0
            for m, c in models.items():
                own = far[:, at : at + len(c)]
                at += len(c)
                nearest = own.argmin(1)
                held[m][0] += np.bincount(nearest, minlength=len(c))
                held[m][1] += np.bincount(nearest, weights=own[np.arange(len(x)), nearest], minlength=len(c))
                for d in range(dims):
                    held[m][2][:, d] += np.bincount(nearest, weights=x[:, d], minlength=len(c))
        rows = [(m, j, int(n[j]), float(cost[j]), total[j].tolist()) for m, (n, cost, total) in held.items() for j in range(len(n))]
        yield pd.DataFrame(rows, columns=SUMS.names)

    parts = points.mapInPandas(sums, SUMS)
    added = F.array(*[F.sum(F.col("sums")[d]) for d in range(dims)])
    rows = parts.groupBy("model", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), added.alias("sums")).collect()
    out = {m: [np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)] for m, c in models.items()}
    for r in rows:
        for held, value in zip(out[r["model"]], (r["n"], r["cost"], r["sums"]), strict=True):
            held[r["centre"]] = value
    return out


ENDED = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("centres", T.ArrayType(T.DoubleType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("inertia", T.DoubleType())])


def _lloyd(x: np.ndarray, centres: np.ndarray, max_iter: int, limit: float, block: int = 8192) -> Clustering:
    """One k-means run over points in memory, by the same steps as the shared passes."""
    k = len(centres)
    for _ in range(max_iter):
        n, cost, total = np.zeros(k), 0.0, np.zeros(centres.shape)
        for at in range(0, len(x), block):
            some = x[at : at + block]
            far = np.ascontiguousarray(_square_distances(some, centres).T)
            least = far.min(axis=0)
            nearest = np.zeros(len(some), dtype=np.intp)
            for j in range(k - 1, -1, -1):  # ties go to the smaller centre
                nearest[far[j] == least] = j
            own = np.zeros((k, len(some)))
            own[nearest, np.arange(len(some))] = 1
            n, cost, total = n + own.sum(1), cost + float(least.sum()), total + own @ some
        new = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], centres)
        moved, found = float(np.square(new - centres).sum()), Clustering(centres, n, cost)
        if moved <= limit:
            break
        centres = new
    return found


def _whole_runs(points: DataFrame, runs: dict[int, np.ndarray], dims: int, max_iter: int, limit: float) -> dict[int, Clustering]:
    """All runs, each in one task over all points: for tables that fit a task, so that steps need no jobs."""
    spark = points.sparkSession
    flat = points.select(F.col("x")).toArrow()["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dims)
    x = x[np.lexsort(x.T)]  # sums don't depend on the order in which rows came
    shared = spark.sparkContext.broadcast((x, runs))

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, runs = shared.value
        for batch in batches:
            for i in batch["run"].tolist():
                c = _lloyd(x, runs[i], max_iter, limit)
                yield pd.DataFrame([(i, c.centres.ravel().tolist(), c.sizes.astype(int).tolist(), c.inertia)], columns=ENDED.names)

    jobs = spark.sparkContext.parallelize([(i,) for i in runs], len(runs)).toDF("run int")
    try:
        rows = jobs.mapInPandas(end, ENDED).collect()
    finally:
        shared.unpersist()
    return {r["run"]: Clustering(np.array(r["centres"]).reshape(-1, dims), np.array(r["sizes"], dtype=float), r["inertia"]) for r in rows}


def cluster(points: DataFrame, dims: int, ks: Sequence[int], restarts: int = 20, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, start_rows: int = 10_000) -> dict[int, Clustering]:
    """By k, the best of ``restarts`` k-means runs over the points (x).

    Points of at most 4 million values are sent to the tasks, which take whole runs; else all runs of all k share each pass.

    Start centres come from k-means++ on at most ``start_rows`` rows in the order of a hash. A run is done when its
    centres move by less than ``tol`` of the columns' mean variance. An empty cluster keeps its centre.
    """
    sample = np.array([r["x"] for r in points.orderBy(F.xxhash64("x")).limit(start_rows).collect()], dtype=float).reshape(-1, dims)
    if not len(sample):
        return {}
    rng, limit = np.random.default_rng(seed), tol * float(sample.var(axis=0).mean())
    runs = {i: _plus_plus(sample, k, rng) for i, k in enumerate(k for k in ks for _ in range(restarts))}
    kinds = [k for k in ks for _ in range(restarts)]
    done: dict[int, Clustering] = {}
    if points.count() * dims <= CELLS:
        done, runs = _whole_runs(points, runs, dims, max_iter, limit), {}
    for _ in range(max_iter if runs else 0):
        found = _one_pass(points, runs, dims)
        for i, (n, cost, total) in found.items():
            new = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], runs[i])
            moved = float(np.square(new - runs[i]).sum())
            done[i] = Clustering(runs[i], n, float(cost.sum()))
            if moved <= limit:
                del runs[i]
            else:
                runs[i] = new
        if not runs:
            break
    best = {k: min((c for i, c in done.items() if kinds[i] == k), key=lambda c: c.inertia) for k in ks}
    out = {}
    for k, c in best.items():
        order = np.lexsort(np.round(c.centres, 9).T[::-1])
        out[k] = Clustering(c.centres[order], c.sizes[order], c.inertia)
    return out


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int = 6, restarts: int = 20, seed: int = 42) -> Clustering:
    """The restart with the smallest inertia."""
    points = _points(df, columns).persist()
    try:
        found = cluster(points, len(columns), [k], restarts, seed)
        if not found:
            raise ValueError("no rows to cluster")
        return found[k]
    finally:
        points.unpersist()


def assign_kmeans(model: Clustering, df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, segment_id): the nearest centre; ties go to the smaller id."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    far = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    nearest = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(model.centres)]))
    return df.select(key, nearest["i"].cast("long").alias("segment_id"))


def silhouettes(points: DataFrame, dims: int, models: dict[int, np.ndarray], queries: int = 1000) -> dict[int, float]:
    """By model, the mean Euclidean silhouette of at most ``queries`` points, each against all points.

    The points asked for are the first in the order of a hash; if there are no more, the value is exact.
    """
    asked = np.array([r["x"] for r in points.orderBy(F.xxhash64("x")).limit(queries).collect()], dtype=float).reshape(-1, dims)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {m: np.zeros(len(c), dtype=np.int64) for m, c in models.items()}
        totals = {m: np.zeros((len(c), len(asked))) for m, c in models.items()}
        for batch in batches:
            every = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), dims)
            for at in range(0, len(every), 2000):
                x = every[at : at + 2000]
                far = np.sqrt(np.square(x[:, None, :] - asked[None]).sum(2))
                for m, c in models.items():
                    nearest = _square_distances(x, c).argmin(1)
                    sizes[m] += np.bincount(nearest, minlength=len(c))
                    for j in range(len(c)):
                        totals[m][j] += far[nearest == j].sum(0)
        for m, c in models.items():
            for j in range(len(c)):
                yield pd.DataFrame({"model": m, "centre": j, "query": np.arange(len(asked)), "n": sizes[m][j], "total": totals[m][j]})

    rows = points.mapInPandas(distances, APART).groupBy("model", "centre", "query").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = {}
    for m, c in models.items():
        n, total = np.zeros(len(c)), np.zeros((len(c), len(asked)))
        for r in rows:
            if r["model"] == m:
                n[r["centre"]], total[r["centre"], r["query"]] = r["n"], r["total"]
        own, at = _square_distances(asked, c).argmin(1), np.arange(len(asked))
        inner = total[own, at] / np.maximum(1, n[own] - 1)
        means = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], np.inf)
        means[own, at] = np.inf
        outer = means.min(axis=0)
        value = np.where((n[own] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
        out[m] = float(value.mean()) if len(value) else 0.0
    return out


def k_sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(3, 10), restarts: int = 20) -> tuple[DataFrame, DataFrame]:
    """By k, inertia, Euclidean silhouette and the smallest and largest share; and (k, segment_id, size, share)."""
    spark, points = df.sparkSession, _points(df, columns).persist()
    try:
        found = cluster(points, len(columns), ks, restarts)
        near = silhouettes(points, len(columns), {k: c.centres for k, c in found.items()}) if found else {}
    finally:
        points.unpersist()
    rows = [(int(k), c.inertia, near[k], float(c.sizes.min() / c.sizes.sum()), float(c.sizes.max() / c.sizes.sum())) for k, c in found.items()]
    sizes = [(int(k), j, int(n), float(n / c.sizes.sum())) for k, c in found.items() for j, n in enumerate(c.sizes)]
    measures = spark.createDataFrame(rows, "k int, inertia double, silhouette double, smallest double, largest double")
    return measures, spark.createDataFrame(sizes, "k int, segment_id int, size long, share double")


def nearest_centre(points: DataFrame, key: str, vec: str, centres: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, centre, distance) of the nearest of a few centres (centre, cvec); ties go to the smaller centre.

    The centres are one row with an array, which is sent to all tasks: points are neither multiplied nor shuffled.
    """
    size = centres.count()
    if size > most:
        raise ValueError(f"{size} centres are too many to be sent to every task")
    listed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("centre"), F.col("cvec")))).alias("__centres"))
    square = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    far = lambda c: F.aggregate(F.zip_with(vec, c["cvec"], square), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("__centres", lambda c: F.struct(far(c).alias("d"), c["centre"].alias("c"))))
    found = points.crossJoin(F.broadcast(listed)).select(key, best.alias("x")).where(F.col("x").isNotNull())
    return found.select(key, F.col("x.c").alias("centre"), F.sqrt("x.d").alias("distance"))


@dataclass(frozen=True)
class Als:
    """A fitted model with the encodings of its users (user_id, uidx) and items (item_id, tidx)."""

    model: ALSModel
    users: DataFrame
    items: DataFrame

    def vectors(self, side: str) -> DataFrame:
        """(id, vec) of the users or items."""
        factors, names, idx, key = (self.model.userFactors, self.users, "uidx", "user_id") if side == "users" else (self.model.itemFactors, self.items, "tidx", "item_id")
        return factors.select(F.col("id").cast("long").alias(idx), F.transform("features", lambda x: x.cast("double")).alias("vec")).join(names, idx).select(key, "vec")


def typed_scores(scores: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(uidx, tidx, score) in the types of the library."""
    return scores.join(users, "user_id").join(items, "item_id").select(F.col("uidx").cast("int").alias("uidx"), F.col("tidx").cast("int").alias("tidx"), F.col("score").cast("float").alias("score"))


def fit_als(scores: DataFrame, rank: int = 16, iterations: int = 10, reg: float = 0.1, alpha: float = 0.5, seed: int = 42, encoded: tuple[DataFrame, DataFrame] | None = None, typed: DataFrame | None = None) -> Als:
    """Implicit ALS on (user_id, item_id, score); ids of any size are encoded first, as the library takes 32 bits."""
    users, items = encoded or (encode_ids(scores, "user_id", "uidx"), encode_ids(scores, "item_id", "tidx"))
    typed = typed_scores(scores, users, items) if typed is None else typed
    als = ALS(userCol="uidx", itemCol="tidx", ratingCol="score", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="drop")
    return Als(als.fit(typed), users, items)


def als_top_n(als: Als, users: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """By user, the n best items not seen, whatever the length of a history: products of the factors, with what was seen masked."""
    from tidemark.operators.graph import score_top_n

    wanted = als.vectors("users").join(users.select("user_id").distinct(), "user_id", "left_semi")
    return score_top_n(wanted, als.vectors("items"), seen.select("user_id", "item_id").distinct(), n).withColumn("score", F.round("score", 6))


def grid(param_rows: Sequence[dict], run, parallel: int = 8) -> list[dict]:
    """Results of a function over parameter combinations, best NDCG first; a few are run at a time."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        found = list(pool.map(lambda p: {**p, **run(**p)}, param_rows))
    return sorted(found, key=lambda r: -r["ndcg"])


#: The combinations of the grid search, and the iterations tried for the best of them.
ALS_GRID = {"rank": (16, 32, 64, 128), "reg": (0.01, 0.1, 1.0, 10.0), "alpha": (0.5, 1.0, 2.0, 5.0, 10.0)}
ALS_ITERATIONS = (10, 15, 20, 30, 50)


def combinations(values: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(values, row, strict=True)) for row in product(*values.values())]


#: Most values that a product makes at once.
CELLS = 4_000_000


class Cover:
    """A symmetric matrix by a few hubs that all its entries touch: the rows of the other nodes (leaves) are dense in the hubs.

    With leaves first the matrix is [[0, b], [b', c]]; products are two of dense matrices, and powers need only the hubs' square.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, hubs: np.ndarray, n: int):
        self.hub_at = np.full(n, -1)
        self.hub_at[hubs] = np.arange(len(hubs))
        leaves = np.flatnonzero(self.hub_at < 0)
        self.leaf_at = np.full(n, -1)
        self.leaf_at[leaves] = np.arange(len(leaves))
        self.hubs, self.leaves = (slice(x[0], x[-1] + 1) if len(x) and x[-1] - x[0] + 1 == len(x) else x for x in (hubs, leaves))
        self.b, self.c = np.zeros((len(leaves), len(hubs))), np.zeros((len(hubs), len(hubs)))
        for out, at in ((self.b, self.leaf_at), (self.c, self.hub_at)):
            own = (at[src] >= 0) & (self.hub_at[dst] >= 0)
            np.add.at(out, (at[src[own]], self.hub_at[dst[own]]), w[own])

    @cached_property
    def square(self) -> np.ndarray:
        return self.b.T @ self.b

    def series(self, weights: Sequence[float], own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a sum over powers by their weights, from the hubs' rows and b' times the leaves': what b takes to the leaves, and the hubs' result."""
        hubs, steps = [own], weights[1:]
        for n in range(len(steps)):  # a leaf's value after a step is b times the hubs' before it
            hubs.append(self.c @ hubs[-1] + (below if n == 0 else self.square @ hubs[-2]))
        down = sum((w * h for w, h in zip(steps, hubs, strict=False)), np.zeros_like(own))
        return down, sum(w * h for w, h in zip(weights, hubs, strict=True))


class Sparse:
    """A symmetric matrix as sorted edges; products add up by row, or go over a :class:`Cover` where there is a small one."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        order = np.argsort(src, kind="stable")
        src, self.dst, self.w, self.n = src[order], dst[order].astype(np.int32, copy=False), w[order], n
        self.starts = np.flatnonzero(np.diff(src, prepend=-1))
        self.rows = src[self.starts]

    @cached_property
    def cover(self) -> Cover | None:
        """The ends with more edges, if they are at most 600 and a dense table of the others is neither large nor nearly empty."""
        each = np.diff(np.append(self.starts, len(self.dst)))
        src, deg = np.repeat(self.rows, each), np.zeros(self.n, dtype=np.int64)
        deg[self.rows] = each
        first = (deg[src] > deg[self.dst]) | (deg[src] == deg[self.dst]) & (src >= self.dst)
        hubs = np.unique(np.where(first, src, self.dst))
        cells = (self.n - len(hubs)) * len(hubs)
        return Cover(src, self.dst, self.w, hubs, self.n) if 0 < len(hubs) <= min(600, self.n - 1) and cells <= min(5 * CELLS, 50 * len(self.dst)) else None

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out, by = np.zeros((self.n, x.shape[1])), self.cover
        if by:
            out[by.leaves] = by.b @ x[by.hubs]
            out[by.hubs] = by.b.T @ x[by.leaves] + by.c @ x[by.hubs]
            return out
        ends, at = np.append(self.starts[1:], len(self.dst)), 0
        while at < len(self.rows):  # rows whose edges make few values at once, one row at least
            to = max(at + 1, int(np.searchsorted(ends, self.starts[at] + CELLS // max(1, x.shape[1]), side="right")))
            part = slice(self.starts[at], ends[to - 1])
            out[self.rows[at:to]] = np.add.reduceat(self.w[part, None] * x[self.dst[part]], self.starts[at:to] - self.starts[at], axis=0)
            at = to
        return out

    def series(self, weights: Sequence[float], x: np.ndarray, given: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
        """The sum over powers of the matrix by their weights, times x; ``given``: the rows that x has, ``wanted``: those of the result."""
        if given is not None and wanted is not None:
            return self.series(weights, x, given)[wanted]
        by = self.cover
        if not by:
            if given is not None:
                full = np.zeros((self.n, x.shape[1]))
                full[given] = x
                x = full
            total = weights[0] * x
            for w in weights[1:]:
                x = self @ x
                total += w * x
            return total if wanted is None else total[wanted]
        if given is None:
            own, below = x[by.hubs], by.b.T @ x[by.leaves]
        else:
            own, leaf = np.zeros((len(by.c), x.shape[1])), by.leaf_at[given] >= 0
            own[by.hub_at[given[~leaf]]] = x[~leaf]
            below = by.b[by.leaf_at[given[leaf]]].T @ x[leaf]
        down, top = by.series(weights, own, below)
        if wanted is None:
            out = np.empty((self.n, x.shape[1]))
            out[by.leaves], out[by.hubs] = by.b @ down, top
        else:
            out, leaf = np.empty((len(wanted), x.shape[1])), by.leaf_at[wanted] >= 0
            out[leaf], out[~leaf] = by.b[by.leaf_at[wanted[leaf]]] @ down, top[by.hub_at[wanted[~leaf]]]
        if given is not None:
            out[given[leaf]] += weights[0] * x[leaf]
        elif wanted is None:
            out[by.leaves] += weights[0] * x[by.leaves]
        else:
            out[leaf] += weights[0] * x[wanted[leaf]]
        return out


def _eigenvectors_of_cover(by: Cover, k: int, rng: np.random.Generator, spend: bool = False, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors, exactly: the leaves' part of a vector lies in the range of b or its value is zero.

    In an orthonormal basis q of that range (b = q r, by blocks of rows), the matrix is [[0, r], [r', c]].
    """
    q, inner, hubs = by.b if spend else np.empty_like(by.b), [], by.b.shape[1]
    for at in range(0, len(q), block):
        own, r = np.linalg.qr(by.b[at : at + block])
        q[at : at + block, : own.shape[1]] = own
        inner.append(r)
    outer, r = np.linalg.qr(np.vstack(inner))
    ends = np.cumsum([0, *map(len, inner)])
    for n in range(len(inner)):
        rows = slice(n * block, (n + 1) * block)
        q[rows, : len(r)] = q[rows, : len(inner[n])] @ outer[ends[n] : ends[n + 1]]
    q = q[:, : min(hubs, len(r))]
    values, mix = np.linalg.eigh(np.block([[np.zeros((len(r), len(r))), r], [r.T, by.c]]))
    values, mix = values[::-1], mix[:, ::-1]
    n = len(by.b) + len(by.c)
    zeros = min(max(0, k - int((values > 1e-12).sum())), len(by.b) - len(r))
    before = int((values > 1e-12).sum()) if zeros else k
    vectors = np.zeros((n, min(k, n)))
    first, rest = mix[:, :before], mix[:, before : max(before, vectors.shape[1] - zeros)]
    for at, part in ((0, first), (before + zeros, rest)):
        for c in range(at, min(at + part.shape[1], vectors.shape[1]), 32):
            some = part[:, c - at : c - at + 32]
            vectors[by.leaves, c : c + some.shape[1]] = q @ some[: len(r)]
            vectors[by.hubs, c : c + some.shape[1]] = some[len(r) :]
    if zeros:
        null = rng.normal(size=(len(by.b), zeros))
        for _ in range(2):
            null = np.linalg.qr(null - q @ (q.T @ null))[0]
        vectors[by.leaves, before : before + zeros] = null
    return np.concatenate([values[:before], np.zeros(zeros), values[before:]])[: vectors.shape[1]], vectors


def largest_eigenvectors(a: Sparse, k: int, seed: int = 42, tol: float = 1e-9, most: int = 600, spend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their vectors.

    A matrix that a Krylov space of ``most`` dimensions would nearly fill is solved densely, and one that has a cover of
    at most ``most`` hubs in a space of twice their number; a larger one by a block Krylov space that is started anew
    from its best vectors, and has fewer dimensions where it would hold more than 20 million values. With ``spend`` the
    matrix isn't used again, so its memory may be.
    """
    if a.n <= 2 * most:
        values, vectors = np.linalg.eigh(a @ np.eye(a.n))
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    block = min(a.n, k + 8)
    rng = np.random.default_rng(seed)
    if a.cover and len(a.cover.c) <= most:
        return _eigenvectors_of_cover(a.cover, k, rng, spend)
    most = max(2 * block, min(most, 5 * CELLS // a.n))
    start = np.linalg.qr(rng.normal(size=(a.n, block)))[0]
    for _ in range(200):
        basis, image, last = start, a @ start, start
        while True:
            values, mix = np.linalg.eigh(basis.T @ image)
            top = mix[:, ::-1][:, :k]
            vectors, applied = basis @ top, image @ top
            values = values[::-1][:k]
            if np.linalg.norm(applied - vectors * values, axis=0).max(initial=0) <= tol or basis.shape[1] >= a.n:
                return values, vectors
            if basis.shape[1] + block > min(a.n, most):
                break
            new = image[:, -last.shape[1] :]
            for _ in range(2):
                new = new - basis @ (basis.T @ new)
            last, r = np.linalg.qr(new)
            last = last[:, np.abs(np.diag(r)) > 1e-10]
            if not last.shape[1]:
                last = np.linalg.qr((x := rng.normal(size=(a.n, 1))) - basis @ (basis.T @ x))[0]
            basis, image = np.hstack([basis, last]), np.hstack([image, a @ last])
        start = np.linalg.qr(basis @ mix[:, ::-1][:, :block])[0]
    return values, vectors


def laplacian_vectors(edges: DataFrame, k: int = 8, max_edges: int = 5_000_000, dense_nodes: int = 1000) -> DataFrame:
    """(node, vec) of the k smallest eigenvectors of the normalised Laplacian of a graph (src, dst, w).

    The driver holds the edges, whose number is checked before they are collected; small graphs are solved densely.
    """
    merged = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).persist()
    try:
        if (found := merged.count()) > max_edges:
            raise ValueError(f"{found} edges are more than {max_edges}")
        names = merged.select(F.explode(F.array("src", "dst")).alias("node")).distinct().toArrow()["node"].combine_chunks()
        names = names.take(pc.sort_indices(names))
        index = edges.sparkSession.createDataFrame(pa.table({"node": names, "at": np.arange(len(names), dtype=np.int32)}))
        ids = merged.join(index.select(F.col("node").alias("src"), F.col("at").alias("s")), "src").join(index.select(F.col("node").alias("dst"), F.col("at").alias("d")), "dst")
        rows = ids.select("s", "d", F.col("w").cast("double").alias("w")).toArrow()  # numbers only: names of both ends would fill the driver
    finally:
        merged.unpersist()
    src, dst, w = (rows[c].to_numpy() for c in ("s", "d", "w"))
    order = np.lexsort((dst, src))
    src, dst, w = src[order], dst[order], w[order]
    del rows, order
    src, dst, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    deg = np.bincount(src, weights=w, minlength=len(names))
    half = np.divide(1, np.sqrt(deg), out=np.zeros_like(deg), where=deg > 0)
    w = w * half[src] * half[dst]
    if len(names) <= max(dense_nodes, 4 * k):
        dense = np.eye(len(names))
        np.add.at(dense, (src, dst), -w)
        vecs = np.linalg.eigh(dense)[1][:, :k]
    else:
        matrix = Sparse(src, dst, w, len(names))
        del src, dst, w
        _, vecs = largest_eigenvectors(matrix, k, spend=True)
        del matrix
    return vector_frame(edges.sparkSession, "node", names.cast("string"), vecs)


def vector_frame(spark: SparkSession, key: str, names: pa.Array, vectors: np.ndarray) -> DataFrame:
    """(key, vec) from the rows of a matrix, whose values never become Python objects; a large one is handed over in parts."""
    from tidemark.operators.graph import cut

    step, parts = max(1, CELLS // max(1, vectors.shape[1])), []
    for at in range(0, max(1, len(vectors)), step):
        some = np.ascontiguousarray(vectors[at : at + step], dtype=float)
        lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * vectors.shape[1], pa.array(some.ravel()))
        parts.append(spark.createDataFrame(pa.table({key: names[at : at + step], "vec": lists})))
        if len(vectors) > step:
            parts[-1] = parts[-1].transform(cut)
    return reduce(DataFrame.unionByName, parts)


def truncate_basis(vectors: DataFrame, columns: int, normalise: bool) -> DataFrame:
    """First columns of (node, vec), optionally scaled to unit length."""
    cut = vectors.select("node", F.slice("vec", 1, columns).alias("vec"))
    if not normalise:
        return cut
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return cut.select("node", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0))).alias("vec"))


def bootstrap_difference(by_user: DataFrame, a: str, b: str, rounds: int = 5000, level: float = 0.95) -> DataFrame:
    """Mean difference b - a with a percentile interval over paired resamples.

    Each row takes part in each round a Poisson(1) number of times, by a hash of its id and the round: one
    map-side pass and one aggregation by round.
    """
    u = (F.pmod(F.xxhash64("user_id", "round"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = reduce(lambda acc, s: acc + (F.col("u") > s).cast("int"), steps, F.lit(0))
    drawn = by_user.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select("round", (F.col(b) - F.col(a)).alias("d"), u).withColumn("n", times)
    means = drawn.groupBy("round").agg(F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("m"))
    observed = by_user.agg(F.avg(F.col(b) - F.col(a)).alias("difference"))
    ends = means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return observed.crossJoin(F.broadcast(ends))


def sample_negatives(pairs: DataFrame, items: DataFrame, per_pair: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id, draw, negative): for each pair ``per_pair`` items that the user has no pair with; ``items`` has a dense index tidx.

    A hash picks among the user's unseen items: the r-th of them is found by a walk over the seen ones in order,
    so no draw is rejected. A user who has seen all items gives no rows.
    """
    total = items.count()
    seen = pairs.join(items.select("item_id", "tidx"), "item_id").groupBy("user_id").agg(F.array_sort(F.collect_set("tidx")).alias("__seen"))
    drawn = pairs.join(seen, "user_id").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_pair)))).withColumn("__left", F.lit(total) - F.size("__seen"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))
    nth = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long"), F.col("__left").cast("long"))
    at = F.aggregate("__seen", nth, lambda r, s: F.when(s <= r, r + 1).otherwise(r)).alias("tidx")
    found = drawn.where("__left > 0").select("user_id", "item_id", "draw", at)
    return found.join(items.select("tidx", F.col("item_id").alias("negative")), "tidx").select("user_id", "item_id", "draw", "negative")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a portable hash of their key: the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """Fold 0 to folds - 1 of each row, balanced within each label by position in a hash order of its bucket."""
    bucketed = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(1024)))
    order = Window.partitionBy(label, "__b").orderBy(F.xxhash64(key, F.lit(7)), key)
    return bucketed.withColumn("fold", F.pmod(F.row_number().over(order) + F.col("__b"), F.lit(folds)).cast("int")).drop("__b")


#: Models that cross-validation compares, by name.
MODELS = {
    "logistic": lambda: LogisticRegression(featuresCol="__features"),
    "ridge_logistic": lambda: LogisticRegression(featuresCol="__features", regParam=0.1),
    "random_forest": lambda: RandomForestClassifier(featuresCol="__features", numTrees=20, seed=42),
    "boosted_trees": lambda: GBTClassifier(featuresCol="__features", maxIter=10, seed=42),
}


def cross_validate(df: DataFrame, features: Sequence[str], label: str, folds: int, names: Sequence[str] = tuple(MODELS), parallel: int = 4) -> DataFrame:
    """AUC by model and fold; ``df`` has a column fold. A few fits run at a time."""
    ready = _vectors(df, features).select("__features", F.col(label).cast("double").alias("label"), "fold").cache()

    def one(job: tuple[str, int]) -> tuple[str, int, float]:
        name, k = job
        model = MODELS[name]().fit(ready.where(F.col("fold") != k))
        return name, k, float(BinaryClassificationEvaluator().evaluate(model.transform(ready.where(F.col("fold") == k))))

    try:
        ready.count()
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            rows = list(pool.map(one, product(names, range(folds))))
    finally:
        ready.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, fold int, auc double")


def sampler_run(
    edges: DataFrame,
    seeds: DataFrame,
    pool: DataFrame,
    chunk: int,
    rounds: int,
    labels: DataFrame | None = None,
    criterion: int | None = None,
    reverse: bool = False,
    done: DataFrame | None = None,
    col_refine: float = 0.0,
) -> DataFrame:
    """Users chosen for labelling: the seeds, then in each round the best chunk of the pool; (u, round).

    Criterion 3, the default where there are ``labels`` (user_id, persona), takes the largest entropy plus
    divergence under what the users chosen so far are labelled; criterion 1 takes those who know fewest unseen
    items. ``reverse`` scores by the reverse walk, where users that no label reaches come first; above 0,
    ``col_refine`` weighs frequent personas down in it (see ``graph.reverse_prediction``). The walk is
    summed over ``edges`` without a row for each pair of users. ``done``, an earlier run's result, is continued
    after its last round, so ``rounds`` more rounds of a stopped run give what one long run gives.
    """
    from tidemark.operators import graph
    from tidemark.operators.graph import cut
    from tidemark.operators.quality import shares

    spark = edges.sparkSession
    criterion = criterion or (1 if labels is None else 3)
    if criterion not in (1, 3) or criterion == 3 and labels is None:
        raise ValueError("criterion 1, or 3 with labels")
    table = lambda rows: spark.createDataFrame(rows, "u long, round int").coalesce(1)
    picked = [(r["u"], 0) for r in seeds.select("u").collect()] if done is None else [(r["u"], r["round"]) for r in done.select("u", "round").collect()]
    first = 1 + max((r for _, r in picked), default=0)
    if criterion == 3:
        steps, labels = graph.walk_steps(edges).transform(cut), labels.transform(cut)  # rounds don't repeat what these come from
        users = steps.select("u").distinct().count()
    pool = pool.select("u").transform(cut)
    for i in range(first, first + rounds):
        chosen = table(picked)
        rest = pool.select("u").join(chosen.select("u"), "u", "left_anti")
        if criterion == 1:
            known = edges.join(chosen.select("u"), "u", "left_semi").select("t").distinct()
            ranked = graph.coverage_rank(rest, edges, known).select("u", (-F.col("unseen")).alias("gain"))
        else:
            known = labels.join(chosen.select(F.col("u").alias("user_id")), "user_id", "left_semi").transform(cut)
            scores = graph.reverse_walk(edges, known) if reverse else graph.forward_scores(steps, known, users)
            if reverse and col_refine > 0:
                scores = graph.reverse_prediction(scores, known, col_refine)
            scores = scores.transform(cut)
            current = shares(known, "persona").select("persona", F.col("share").alias("q"))
            ranked = rest.join(graph.information_rank(scores, current, 1e-16 if reverse else 0.0), "u", "left")
        best = [(r["u"], i) for r in ranked.orderBy(F.desc_nulls_first(F.round("gain", 12)), F.xxhash64("u"), "u").limit(chunk).collect()]
        if not best:
            break
        picked += best
    return table(picked)


def sampler_state(run: DataFrame, edges: DataFrame) -> DataFrame:
    """By round of a sampler's run (u, round), the users labelled and the items known when it ends."""
    first = edges.join(run, "u").groupBy("t").agg(F.min("round").alias("round")).groupBy("round").agg(F.count(F.lit(1)).alias("items"))
    users = run.groupBy("round").agg(F.count(F.lit(1)).alias("users"))
    so_far = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)  # one row a round
    both = users.join(first, "round", "left")
    return both.select("round", F.sum("users").over(so_far).alias("labelled"), F.coalesce(F.sum("items").over(so_far), F.lit(0)).alias("known_items"))


def save_als(als: Als, path: str) -> None:
    """Keep a model with the encodings it was trained under."""
    als.model.write().overwrite().save(f"{path}/model")
    als.users.write.mode("overwrite").parquet(f"{path}/users")
    als.items.write.mode("overwrite").parquet(f"{path}/items")


def load_als(spark, path: str) -> Als:
    return Als(ALSModel.load(f"{path}/model"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"))


def repeat_runs(run, seeds: Sequence[int]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of a run's metrics over seeds."""
    rows = [run(seed) for seed in seeds]
    return {k: (float(np.mean([r[k] for r in rows])), float(np.std([r[k] for r in rows]))) for k in rows[0]}
