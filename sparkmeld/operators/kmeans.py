"""K-Means by Lloyd's iterations: centroids (k x d numbers) go out to the tasks, one aggregation comes back per iteration.

An iteration's sums are taken in numpy on Arrow batches: centroids as literals would be new code to compile each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import squared_l2


def assigned(points: DataFrame, centroids: Sequence[Sequence[float]], dims: int) -> DataFrame:
    """points(x) with cluster (nearest centroid, ties to the lesser) and d2."""
    choices = [F.struct(squared_l2(F.col("x"), F.array(*[F.lit(float(v)) for v in c]), dims).alias("d2"), F.lit(i).alias("k")) for i, c in enumerate(centroids)]
    best = F.least(*choices) if len(choices) > 1 else choices[0]
    return points.withColumn("_best", best).withColumn("cluster", F.col("_best.k")).withColumn("d2", F.col("_best.d2")).drop("_best")


#: Classes whose means may start clusters.
MOST_CLASSES = 10_000


def class_means(points: DataFrame, label: str, dims: int) -> list[list[float]]:
    """The mean of x of every label, in the labels' order; rows without one are in none."""
    rows = points.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(dims)]).orderBy(label).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return [[r[f"c{i}"] for i in range(dims)] for r in rows]


def _runs(points: DataFrame, runs: Sequence[Sequence[Sequence[float]]], dims: int) -> DataFrame:
    """points with (run, cluster, d2): a row for each run's nearest centroid."""
    best = []
    for no, centroids in enumerate(runs):
        choices = [F.struct(squared_l2(F.col("x"), F.array(*[F.lit(float(v)) for v in c]), dims).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]
        near = F.least(*choices) if len(choices) > 1 else choices[0]
        best.append(F.struct(F.lit(no).alias("run"), near.alias("near")))
    return points.withColumn("_best", F.explode(F.array(*best))).select(*points.columns, "_best.run", F.col("_best.near.cluster").alias("cluster"), F.col("_best.near.d2").alias("d2"))


def lloyd(points: DataFrame, centroids: Sequence[Sequence[float]], dims: int, iterations: int = 300, tolerance: float | None = 1e-4, relative: bool = True) -> list[list[float]]:
    """Centroids after the iterations; see lloyd_runs."""
    return lloyd_runs(points, [centroids], dims, iterations, tolerance, relative)[0]


_PARTIAL = "run int, cluster int, n long, s array<double>, d2 double, far array<double>, h long, drawn array<double>"


def _partials(points: DataFrame, runs: Sequence[np.ndarray], dims: int, salt: int) -> DataFrame:
    """A row for each task, run and cluster: number and sums of members, the farthest of them, and one drawn by a hash of its values."""
    centroids = [np.asarray(c, float) for c in runs]
    odd = np.random.default_rng(salt).integers(1, 1 << 62, dims, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :dims] if batch.num_rows else np.zeros((0, dims))
            with np.errstate(over="ignore"):
                h = (x.view(np.uint64) * odd).sum(1, dtype=np.uint64) if x.flags.c_contiguous else (np.ascontiguousarray(x).view(np.uint64) * odd).sum(1, dtype=np.uint64)
                h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
            for no, c in enumerate(centroids):
                d2 = sum((x[:, None, i] - c[None, :, i]) ** 2 for i in range(dims))
                own, near = d2.argmin(1), d2.min(1)
                for k in np.unique(own):
                    rows = np.flatnonzero(own == k)
                    top, low = rows[near[rows].argmax()], rows[h[rows].argmin()]
                    had = out.setdefault((no, int(k)), [0, np.zeros(dims), (-1.0, []), (1 << 63, [])])
                    had[0] += len(rows)
                    had[1] = had[1] + x[rows].sum(0)
                    had[2] = max(had[2], (float(near[top]), x[top].tolist()))
                    had[3] = min(had[3], (int(h[low]), x[low].tolist()))
        rows = [(no, k, n, s.tolist(), *far, *drawn) for (no, k), (n, s, far, drawn) in sorted(out.items())]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["run", "cluster", "n", "s", "d2", "far", "h", "drawn"])

    return points.select(F.transform("x", lambda v: v.cast("double"))).mapInArrow(run, _PARTIAL)


def lloyd_runs(points: DataFrame, starts: Sequence[Sequence[Sequence[float]]], dims: int, iterations: int = 300, tolerance: float | None = 1e-4, relative: bool = True, seed: int = 42) -> list[list[list[float]]]:
    """The centroids of several runs, each iteration one job for all that go on.

    The first empty cluster of a run moves to the point that is farthest from its centroid, further ones to points drawn
    by a hash of their values. A run stops when its centroids' shift is at most tolerance (times their norm, if relative
    and over 1); None: never early.
    """
    now = [np.asarray(c, float) for c in starts]
    open_ = list(range(len(now)))
    for step in range(iterations):
        parts = _partials(points, [now[i] for i in open_], dims, seed + step).groupBy("run", "cluster")
        rows = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)], F.max(F.struct("d2", "far")).alias("far"), F.min(F.struct("h", "drawn")).alias("drawn")).collect()  # runs x k rows
        ended = []
        for no, i in enumerate(open_):
            own = {r.cluster: r for r in rows if r.run == no}
            if not own:
                ended.append(i)
                continue
            new = now[i].copy()
            for k, r in own.items():
                new[k] = [r[f"s{j}"] / r.n for j in range(dims)]
            moves = [max(own.values(), key=lambda r: r.far.d2).far.far, *(r.drawn.drawn for r in sorted(own.values(), key=lambda r: r.drawn.h))]
            for turn, k in enumerate(k for k in range(len(new)) if k not in own):
                new[k] = moves[min(turn, len(moves) - 1)][:dims]
            shift, size = np.linalg.norm(new - now[i]), np.linalg.norm(now[i])
            now[i] = new
            if tolerance is not None and shift <= tolerance * (max(1.0, size) if relative else 1.0):
                ended.append(i)
        open_ = [i for i in open_ if i not in ended]
        if not open_:
            break
    return [c.tolist() for c in now]


def draw(near: DataFrame, uniforms: Sequence[float], parts: int = 64) -> DataFrame:
    """near(id, d2) -> (u, picked): for each uniform number the first id whose running sum of d2 reaches that share of all.

    Running sums are of ranges of ids first, then of rows within the range that holds the draw.
    """
    cuts = near.select(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("c"))
    rows = near.crossJoin(F.broadcast(cuts)).select("id", "d2", F.size(F.filter("c", lambda x: x < F.col("id"))).alias("part"))  # one row
    sums = rows.groupBy("part").agg(F.sum("d2").alias("s"))
    upto = sums.select("part", "s", F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.sum("s").over(W.partitionBy(F.lit(0))).alias("total"))  # at most `parts` rows
    asked = upto.crossJoin(F.broadcast(near.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(u)) for u in uniforms])).alias("u"))))
    asked = asked.withColumn("before", F.coalesce("before", F.lit(0.0))).where((F.col("before") + F.col("s") >= F.col("u") * F.col("total")) & (F.col("before") < F.col("u") * F.col("total")))
    inside = rows.join(F.broadcast(asked), "part").withColumn("upto", F.col("before") + F.sum("d2").over(W.partitionBy("u").orderBy("id")))
    return inside.where(F.col("upto") >= F.col("u") * F.col("total")).groupBy("u").agg(F.min("id").alias("picked"))


def plus_plus(points: DataFrame, k: int, dims: int, seeds: Sequence[int] = (42,)) -> list[list[list[float]]]:
    """k-means++ starts of several runs: each next centroid is drawn by its squared distance, all runs in one job a draw.

    The draw is an exponential race of hashes, whose least has the odds of a cumulative sum and search but needs no
    order of all rows; draw() is the search.
    """
    rngs = [np.random.default_rng(s) for s in seeds]
    race = lambda salt: F.min(F.struct((-F.log((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) + 1) / float(1 << 40))).alias("race"), "id", "x"))
    first = points.agg(*[race(int(r.integers(1 << 31))).alias(f"b{i}") for i, r in enumerate(rngs)]).first()
    runs = [[list(first[i].x[:dims])] for i in range(len(rngs))]
    for _ in range(k - 1):
        salts = F.array(*[F.lit(int(r.integers(1 << 31))) for r in rngs])
        u = (F.pmod(F.xxhash64("id", F.get(salts, F.col("run"))), F.lit(1 << 40)) + 1) / float(1 << 40)
        got = _runs(points, runs, dims).where("d2 > 0").withColumn("race", -F.log(u) / F.col("d2")).groupBy("run").agg(F.min(F.struct("race", "id", "x")).alias("b")).collect()  # a row a run
        picked = {r.run: list(r.b.x[:dims]) for r in got}
        for i, run in enumerate(runs):
            run.append(picked.get(i, run[0]))
    return runs


def best_of(points: DataFrame, k: int, dims: int, runs: int = 10, seed: int = 42, **settings) -> tuple[list[list[float]], float]:
    """(centroids, inertia) of the run of least inertia, the earlier of equals."""
    ended = lloyd_runs(points, plus_plus(points, k, dims, range(seed, seed + runs)), dims, **settings)
    inertia = {r.run: r.s for r in _runs(points, ended, dims).groupBy("run").agg(F.sum("d2").alias("s")).collect()}
    best = min(inertia, key=lambda i: (inertia[i], i))
    return ended[best], inertia[best]


def cluster_map(members: DataFrame, label: str = "label", order: str = "id") -> DataFrame:
    """cluster -> its most frequent label; ties to the label seen first."""
    votes = members.groupBy("cluster", label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return votes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(label).alias("label"))).alias("b"), F.sum("n").alias("size")).select("cluster", F.col("b.label").alias("label"), (-F.col("b.n")).alias("majority"), "size")


def purity(members: DataFrame, clusters: int, strict: bool = True, label: str = "label") -> DataFrame:
    """Share of members with their cluster's label; strict: 0 if a cluster is empty."""
    out = cluster_map(members, label).agg((F.sum("majority") / F.sum("size")).alias("purity"), F.count(F.lit(1)).alias("used"))
    return out.select(F.when(F.lit(strict) & (F.col("used") < clusters), 0.0).otherwise(F.col("purity")).alias("purity"), (F.col("used") == clusters).alias("complete"))


def named(mapped: DataFrame, clusters: int) -> DataFrame:
    """cluster_map() -> (cluster, name) of every cluster: its label in lower case, or `desconocido` for one without members or label."""
    every = mapped.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    return every.join(F.broadcast(mapped.select("cluster", "label")), "cluster", "left").select("cluster", F.coalesce(F.lower("label"), F.lit("desconocido")).alias("name"))


def library(points: DataFrame, k: int, dims: int, seed: int = 42) -> DataFrame:
    """points with the cluster that the library's parallel k-means++ finds: the fast path where starts need not be given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("_v", array_to_vector(F.slice("x", 1, dims)))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")
