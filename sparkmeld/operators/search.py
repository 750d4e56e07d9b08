"""Searches over feature subsets and sub-datasets: candidates are rows of a DataFrame, every task judges its share of them.

Subsets of a table within a counted bound are judged by candidate: the table goes to the tasks, no candidate needs another.
Beyond the bound rows stay where they lie: an iteration of the clusters of a block of candidates is one job, which reads
every row once, and neighbours are those of the operator for tables of any size. Both ways give the same scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import knn, scale, select
from .kmeans import MOST_CLASSES

#: Numbers of a table that goes to the tasks at most (32 MB).
SAMPLE_NUMBERS = 4_000_000
#: Fits of a block, whose centroids go to the tasks in every iteration of a table beyond that.
FITS = 2_048
#: Weight patterns: a factor for features whose name holds a word. The empty one leaves all alike.
PATTERNS: dict[str, dict[str, float]] = {"none": {}}


def pool(df: DataFrame, features: Sequence[str], label: str, top: int = 18) -> list[str]:
    """The features of greatest ANOVA F, ties to the later one, in the order in which they are given."""
    long = df.select(label, F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    best = select.anova_f(long, label).orderBy(F.desc("f"), F.desc("feature")).limit(top).collect()  # `top` rows
    return [features[i] for i in sorted(r.feature for r in best)]


def fits_a_task(df: DataFrame, columns: int) -> bool:
    return df.count() * columns <= SAMPLE_NUMBERS


def sample(df: DataFrame, columns: Sequence[str], *others: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The features of a small table as a matrix, missing ones 0, and other columns, in the order of `id`."""
    n = df.count()
    if n * (len(columns) + len(others)) > SAMPLE_NUMBERS:
        raise ValueError(f"{n} rows are too many to search over: draw a sample first")
    rows = df.select("id", *columns, *others).orderBy("id").toPandas()
    return np.nan_to_num(rows[list(columns)].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0), [rows[c].to_numpy() for c in others]


def class_places(labels: np.ndarray) -> np.ndarray:
    """The place of each label among all in order, of any type; no label is the last class."""
    codes, known = pd.factorize(labels, sort=True)
    return np.where(codes < 0, len(known), codes)


def subsets(spark: SparkSession, n: int, sizes: Sequence[int], tasks: int = 64) -> DataFrame:
    """(no, size, picked): all subsets of the given sizes of n features, in lexicographic order by size."""
    total = sum(comb(n, k) for k in sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = [(i, c) for i, c in enumerate(c for k in sizes for c in combinations(range(n), k)) if i % tasks == part]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["no", "size", "picked"])

    tasks = max(1, min(tasks, total))
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "no long, size int, picked array<int>")


def normalised(x: np.ndarray, norm: str) -> np.ndarray:
    """standard, minmax or none, by column; a constant column is 0."""
    if norm == "standard":
        sd = x.std(0)
        return (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    if norm == "minmax":
        span = np.ptp(x, axis=0)
        return (x - x.min(0)) / np.where(span == 0, 1, span)
    return x


def settle(x: np.ndarray, centroids: np.ndarray, iterations: int = 300) -> tuple[np.ndarray, float]:
    """(cluster of each row, inertia) of Lloyd's iterations until no row moves; an empty cluster keeps its centroid.

    A row is compared again only when centroids may have moved farther than its second nearest was behind the nearest.
    What is left at the end is settled by sums and distances of all rows.
    """
    x = np.asfortranarray(x)  # columns are read one by one
    own, near, sure = _compared(x, centroids)
    whole = True  # the last comparison was of all rows
    rows = np.arange(len(x))
    moved, n, sums = rows, None, None
    went = np.zeros(len(centroids))  # how far each cluster's margin has shrunk since the beginning
    for _ in range(iterations - 1):
        if sums is None or 8 * len(moved) > len(x):
            n, sums = _summed(x, own, len(centroids))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        steps = np.sqrt(((new - centroids) ** 2).sum(1))
        others = np.array([np.delete(steps, k).max(initial=0.0) for k in range(len(steps))])
        went, centroids = went + steps + others, new
        rows = np.flatnonzero(~(sure > went.take(own)))
        fresh, _, margin = _compared(x, centroids, rows)
        at = np.flatnonzero(fresh != own[rows])
        moved, was, now = rows[at], own[rows[at]], fresh[at]
        own[rows], sure[rows] = fresh, margin + went.take(fresh)
        whole = False
        if not len(moved):  # sums without what adding and taking off has left
            n, sums = _summed(x, own, len(centroids))
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
            fresh, near, margin = _compared(x, centroids)
            moved = np.flatnonzero(fresh != own)
            own, sure, sums, whole = fresh, margin + went.take(fresh), None, True
            if not len(moved):
                break
        elif 8 * len(moved) <= len(x):
            (n_in, in_), (n_out, out) = _summed(x[moved], now, len(centroids)), _summed(x[moved], was, len(centroids))
            n, sums = n + n_in - n_out, sums + in_ - out
    if not whole:
        near = ((x - centroids[own]) ** 2).sum(1)
    return own, float(near.sum())


def _summed(x: np.ndarray, own: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, sums) of the rows of each cluster."""
    return np.bincount(own, minlength=clusters), np.stack([np.bincount(own, weights=v, minlength=clusters) for v in x.T], axis=1)


def _compared(x: np.ndarray, centroids: np.ndarray, rows: np.ndarray | None = None, block: int = 4_096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, how much farther the second is, rounding left out) of all or some rows; ties to the lesser."""
    size = len(x) if rows is None else len(rows)
    own, near, margin = np.zeros(size, np.int64), np.empty(size), np.empty(size)
    for lo in range(0, size, block):
        part = [v[lo : lo + block] if rows is None else v.take(rows[lo : lo + block]) for v in x.T]
        mine = own[lo : lo + block]
        best, second = np.full(len(mine), np.inf), np.full(len(mine), np.inf)
        for k, c in enumerate(centroids):
            d2 = (part[0] - c[0]) ** 2
            for v, w in zip(part[1:], c[1:], strict=True):
                d2 += (v - w) ** 2
            mine[d2 < best] = k
            second = np.minimum(second, np.maximum(best, d2))
            best = np.minimum(best, d2)
        near[lo : lo + block] = best
        far = np.sqrt(second)
        with np.errstate(invalid="ignore"):
            margin[lo : lo + block] = far - np.sqrt(best) - 1e-9 * far
    return own, near, margin


def purity(own: np.ndarray, y: np.ndarray, clusters: int, strict: bool = False) -> float:
    """Share of rows with the most frequent label of their cluster; strict: 0 with a cluster empty."""
    classes = int(y.max()) + 1
    counts = np.bincount(own * classes + y, minlength=clusters * classes).reshape(clusters, classes)
    return 0.0 if strict and (counts.sum(1) == 0).any() else float(counts.max(1).sum() / len(y))


def _weights(names: Sequence[str], patterns: dict[str, dict[str, float]]) -> dict[str, np.ndarray]:
    return {p: np.array([next((w for word, w in rule.items() if word in name), 1.0) for name in names]) for p, rule in patterns.items()}


_CLUSTERED = "no long, size int, features array<string>, norm string, pattern string, purity double, inertia double"


def cluster_subsets(df: DataFrame, features: Sequence[str], label: str, sizes: Sequence[int], norms: Sequence[str] = ("standard", "minmax", "none"), patterns: dict[str, dict[str, float]] = PATTERNS) -> DataFrame:
    """(no, size, features, norm, pattern, purity, inertia) of clusters begun at the classes' means, for every subset, norm and pattern.

    Missing and infinite numbers are 0, rows without a label a class of their own.
    """
    names = list(features)
    weights = _weights(names, patterns)
    if not fits_a_task(df, len(names) + 1):
        return _cluster_table(df, names, label, sizes, norms, weights)
    x, (labels,) = sample(df, features, label)
    y = class_places(labels)
    clusters = int(y.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {n: normalised(x, n) for n in norms}
        members = [np.flatnonzero(y == k) for k in range(clusters)]
        starts = {(n, p): np.stack([(z[rows] * w).mean(0) for rows in members]) for n, z in ready.items() for p, w in weights.items()}
        for batch in batches:
            out = []
            for no, picked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for norm, z in ready.items():
                    done: dict[bytes, tuple[float, float]] = {}  # patterns that weigh these features alike have the same clusters
                    for pattern, w in weights.items():
                        if (alike := w[picked].tobytes()) not in done:
                            own, inertia = settle(z[:, picked] * w[picked], starts[norm, pattern][:, picked])
                            done[alike] = purity(own, y, clusters), inertia
                        out.append((no, len(picked), [names[i] for i in picked], norm, pattern, *done[alike]))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["no", "size", "features", "norm", "pattern", "purity", "inertia"])

    found = subsets(df.sparkSession, len(names) if clusters else 0, sizes)
    return found.mapInArrow(run, _CLUSTERED)


def _indexed(df: DataFrame, features: Sequence[str], label: str, *others: str) -> DataFrame:
    """(id, y, features, others): numbers that are missing or infinite 0, the label as its place among all, the null label last."""
    classes = df.select(F.col(label).alias("_label")).distinct().orderBy(F.asc_nulls_last("_label")).limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    kind = df.schema[label].dataType.simpleString()
    places = df.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(classes)], f"_label {kind}, y int")
    numbers = [F.when(F.col(f).isNull() | scale.not_finite(f), 0.0).otherwise(F.col(f)).cast("double").alias(f) for f in features]
    # at most MOST_CLASSES rows
    return df.join(F.broadcast(places), F.col(label).eqNullSafe(F.col("_label"))).select("id", "y", *numbers, *others)


_SUMS = "fit int, cluster int, y int, n long, s array<double>, d2 double"


def _cluster_table(df: DataFrame, names: list[str], label: str, sizes: Sequence[int], norms: Sequence[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """cluster_subsets() of a table of any size: the driver holds the centroids of one block of fits."""
    spark = df.sparkSession
    rows = _indexed(df, names, label)
    stats = scale.fit(rows, names).first()
    means = np.array([[r[f"m_{f}"] for f in names] for r in rows.groupBy("y").agg(*[F.avg(f).alias(f"m_{f}") for f in names]).orderBy("y").collect()])
    numbers = lambda kind: np.array([stats[f"{kind}_{f}"] for f in names])
    low, span, mu, sd = numbers("min"), numbers("max") - numbers("min"), numbers("mu"), numbers("sd")
    shift = {"standard": (mu, np.where(sd == 0, 1, sd)), "minmax": (low, np.where(span == 0, 1, span)), "none": (np.zeros(len(names)), np.ones(len(names)))}
    points = rows.select("y", F.array(*names).alias("x"))
    fits = [(no, list(picked), norm, pattern) for no, picked in enumerate(c for k in sizes for c in combinations(range(len(names)), k)) for norm in norms for pattern in weights]
    out = []
    for lo in range(0, len(fits), FITS):
        block = fits[lo : lo + FITS]
        units = [(np.array(p), shift[norm][0][p], weights[pattern][p] / shift[norm][1][p]) for _, p, norm, pattern in block]
        out += [(no, len(p), [names[i] for i in p], norm, pattern, *score) for (no, p, norm, pattern), score in zip(block, _settled(points, units, means), strict=True)]
    return spark.createDataFrame(out, _CLUSTERED)


def _settled(points: DataFrame, units: Sequence[tuple], means: np.ndarray, iterations: int = 300) -> list[tuple[float, float]]:
    """(purity, inertia) of each fit's settled clusters; a fit is columns of x, what is taken off them and their factors.

    Clusters are settled when their members' numbers and sums stay as they were; empty ones keep their centroids.
    """
    now = [(means[:, p] - off) * factor for p, off, factor in units]
    last: list[dict] = [{} for _ in units]
    open_ = list(range(len(units)))
    for _ in range(iterations):
        shared = points.sparkSession.sparkContext.broadcast([(i, units[i], now[i]) for i in open_])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], list] = {}
            for batch in batches:
                y, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                for fit, (p, off, factor), c in shared.value:
                    z = (x[:, p] - off) * factor
                    d2 = ((z[:, None] - c[None]) ** 2).sum(2)
                    own, near = d2.argmin(1), d2.min(1)
                    both, cell, n = np.unique(own * len(c) + y, return_inverse=True, return_counts=True)
                    total = np.stack([np.bincount(cell, weights=v) for v in (*z.T, near)], axis=1)
                    for key, m, t in zip(both.tolist(), n.tolist(), total, strict=True):
                        had = sums.setdefault((fit, *divmod(key, len(c))), [0, 0.0])
                        had[0] += m
                        had[1] = had[1] + t
            cells = [(*k, n, t[:-1].tolist(), float(t[-1])) for k, (n, t) in sums.items()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in cells], t) for i, t in enumerate(kinds)], ["fit", "cluster", "y", "n", "s", "d2"])

        widest = max(len(units[i][0]) for i in open_)
        parts = points.mapInArrow(run, _SUMS).groupBy("fit", "cluster", "y")
        cells = parts.agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(widest)]).alias("s")).collect()  # open fits x clusters x classes
        shared.destroy()
        new: dict[int, dict] = {i: {} for i in open_}
        for r in cells:
            new[r.fit][r.cluster, r.y] = (r.n, np.array(r.s[: len(units[r.fit][0])]), r.d2)
        for i in list(open_):
            same = new[i].keys() == last[i].keys() and all(v[0] == last[i][k][0] and np.allclose(v[1], last[i][k][1], rtol=1e-12, atol=1e-9) for k, v in new[i].items())
            last[i] = new[i]
            if same:
                open_.remove(i)
                continue
            for k in {k for k, _ in new[i]}:
                own = [v for (cluster, _), v in new[i].items() if cluster == k]
                now[i][k] = sum(v[1] for v in own) / sum(v[0] for v in own)
        if not open_:
            break
    scores = []
    for cells in last:
        most: dict[int, int] = {}
        for (k, _), v in cells.items():
            most[k] = max(most.get(k, 0), v[0])
        scores.append((sum(most.values()) / sum(v[0] for v in cells.values()), float(sum(v[2] for v in cells.values()))))
    return scores


def neighbour_accuracy(x: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int = 5) -> float:
    """Mean over folds of the accuracy of the k nearest by L1, weighted by inverse distance, scaled by each training part.

    Ties of distance go to the earlier row, ties of votes to the lesser class.
    """
    parts, own = np.unique(fold, return_inverse=True)
    scale = np.stack([x[own != i].std(0) if (own != i).any() else np.full(x.shape[1], np.nan) for i in range(len(parts))])
    scale[scale == 0] = 1
    row, col, d = knn.nearest(x, x, pa.array(np.arange(len(x))), k, "l1", scale[own], (own, own))
    classes, hit = int(y.max()) + 1, np.empty(len(x))
    step = max(1, SAMPLE_NUMBERS // classes)
    for lo in range(0, len(x), step):
        mine = slice(*np.searchsorted(row, (lo, lo + step)))
        truth = y[lo : lo + step]
        votes = np.bincount((row[mine] - lo) * classes + y[col[mine]], weights=1 / np.maximum(d[mine], 1e-12), minlength=len(truth) * classes).reshape(-1, classes)
        hit[lo : lo + step] = votes.round(9).argmax(1) == truth
    return float(np.mean([hit[own == i].mean() for i in range(len(parts))]))


_SCORED = "no long, size int, features array<string>, accuracy double, perfect boolean"


def neighbour_subsets(df: DataFrame, features: Sequence[str], label: str, fold: str, sizes: Sequence[int], k: int = 5) -> DataFrame:
    """(no, size, features, accuracy, perfect) of cross-validated nearest neighbours for every subset of the features.

    Missing and infinite numbers are 0, rows without a label a class of their own.
    """
    names = list(features)
    if not fits_a_task(df, len(names) + 2):
        return _neighbour_table(df, names, label, fold, sizes, k)
    x, (labels, folds) = sample(df, features, label, fold)
    y = class_places(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.column(2).to_pylist()
            score = [neighbour_accuracy(x[:, p], y, folds, k) for p in picked]
            columns = [batch.column(0), batch.column(1), pa.array([[names[i] for i in p] for p in picked], pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array([s >= 1 - 1e-4 for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["no", "size", "features", "accuracy", "perfect"])

    found = subsets(df.sparkSession, len(names) if len(x) else 0, sizes)
    return found.mapInArrow(run, _SCORED)


def _neighbour_table(df: DataFrame, names: list[str], label: str, fold: str, sizes: Sequence[int], k: int) -> DataFrame:
    """neighbour_subsets() of a table of any size: a subset after the other, each by the neighbours operator; one number of each comes back."""
    rows = _indexed(df, names, label, fold)
    out = []
    for no, picked in enumerate(c for n in sizes for c in combinations(names, n)):
        scores = knn.grid(knn.across_folds(rows, "id", "y", fold, picked, k, "l1"), (k,), ("distance",))
        accuracy = scores.agg(F.avg("accuracy")).first()[0]
        out.append((no, len(picked), list(picked), accuracy, accuracy >= 1 - 1e-4))
    return df.sparkSession.createDataFrame(out, _SCORED)


def best_by_size(found: DataFrame, score: str, top: int = 15) -> DataFrame:
    """The `top` candidates of each size by score; ties to the earlier candidate."""
    place = F.row_number().over(W.partitionBy("size").orderBy(F.desc(score), "no"))
    return found.withColumn("place", place).where(F.col("place") <= top)


def pure_samples(df: DataFrame, features: Sequence[str], label: str, per_class: Sequence[int] = tuple(range(18, 9, -1)), attempts: int = 1000, starts: int = 10, buckets: int = 4, seed: int = 42) -> DataFrame:
    """(per_class, attempt, inertia, ids) of balanced samples whose clusters are their classes, for the greatest size that has any.

    An attempt shuffles sub-clusters of every class, picks rows from them in turn, and clusters the picks from several
    starts, of which that of least inertia counts. Attempts draw from their own seeds, so a task run again finds the same.
    """
    x, (ids, labels) = sample(df.withColumn("_id", F.col("id")), features, "_id", label)
    y = class_places(labels)
    spark, clusters = df.sparkSession, int(y.max(initial=-1)) + 1
    schema = "per_class int, attempt long, inertia double, ids array<long>"
    if not clusters:
        return spark.createDataFrame([], schema)

    def parts(rng: np.random.Generator, members: np.ndarray) -> list[list[int]]:
        z = normalised(x[members], "standard")
        own, _ = settle(z, z[rng.permutation(len(z))[: min(buckets, len(z))]])
        out = []
        for k in np.unique(own):
            inside = np.flatnonzero(own == k)
            near = ((z[inside] - z[inside].mean(0)) ** 2).sum(1)
            out.append(members[inside[np.argsort(near, kind="stable")]].tolist())
        return [out[i] for i in rng.permutation(len(out))]

    def attempt(size: int, no: int) -> tuple | None:
        rng = np.random.default_rng((seed, size, no))
        picks: list[int] = []
        for k in range(clusters):
            turns = [(turn, b, row) for b, rows in enumerate(parts(rng, np.flatnonzero(y == k))) for turn, row in enumerate(rows)]
            picks += [row for _, _, row in sorted(turns)[:size]]
        z = normalised(x[picks], "standard")
        own, inertia = min((settle(z, z[rng.permutation(len(z))[:clusters]]) for _ in range(starts)), key=lambda s: s[1])
        return (size, no, inertia, [int(i) for i in ids[picks]]) if purity(own, y[picks], clusters, strict=True) == 1 else None

    for size in per_class:
        if np.bincount(y).min() < size:
            continue

        def run(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [r for no in batch.column(0).to_pylist() if (r := attempt(size, no))]
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["per_class", "attempt", "inertia", "ids"])

        found = spark.range(attempts).mapInArrow(run, schema)
        if not found.isEmpty():
            return found.orderBy("inertia", "attempt")
    return spark.createDataFrame([], schema)


def summary(found: DataFrame, score: str = "purity") -> str:
    """Counts and the best score of a search as one JSON object."""
    row = found.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.count(F.when(F.col(score) >= 1 - 1e-4, 1)).alias("perfect")).first()
    return json.dumps({"total_checked": row.n, f"best_{score}": row.best, "perfect": row.perfect})
