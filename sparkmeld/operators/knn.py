"""K nearest neighbours: each query keeps its k nearest, of a matrix of all distances or, in few dimensions, of the leaves of a tree near it.

Training rows within a counted bound are sent to the tasks once, and queries are answered where they lie, without a
shuffle. Beyond it blocks of queries meet blocks of training rows, and the k nearest of every meeting go on: rows in
flight are queries x blocks x k, never queries x training rows. Ties go to the lesser training id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.exprs import WEIGHTS
from .tree import POWERS, Tree

#: Rows of a block of queries or training rows, and training rows that are sent to all tasks at most.
BLOCK, BROADCAST_ROWS = 2_048, 131_072
#: Training rows from which on, and dimensions up to which, a tree is faster than all distances.
TREE_ROWS, TREE_DIMS = 1_024, 6


def _power(p: float) -> Callable[[Sequence[np.ndarray]], np.ndarray]:
    return lambda parts: sum(np.abs(x) ** p for x in parts) ** (1 / p)


#: Registry: from the differences by dimension to the distance.
METRICS: dict[str, Callable[[Sequence[np.ndarray]], np.ndarray]] = {"l1": lambda parts: sum(np.abs(x) for x in parts), "l2": lambda parts: np.sqrt(sum(x * x for x in parts)), "minkowski3": _power(3.0)}


def nearest(x: np.ndarray, t: np.ndarray, ids: pa.Array, k: int, metric: str, scale: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, training row, distance) of the k nearest of each query, nearest first, ties by id.

    `scale` divides a query's differences by its own deviations; `apart` gives groups of queries and training rows, and
    only rows of other groups count.
    """
    return Nearest(t, ids, k, metric, None if apart is None else apart[1]).ask(x, scale, None if apart is None else apart[0])


class Nearest:
    """Training rows that are asked in several blocks; see nearest()."""

    def __init__(self, t: np.ndarray, ids: pa.Array, k: int, metric: str, groups: np.ndarray | None = None) -> None:
        self.t, self.k, self.metric = t, k, metric
        self.order = np.asarray(pa.compute.rank(ids, sort_keys="ascending", tiebreaker="first")).astype(np.int64) if len(ids) else np.empty(0, np.int64)
        self.groups, names = (None, []) if groups is None else pd.factorize(groups, use_na_sentinel=False)
        self.known = {None if pd.isna(g) else g: i for i, g in enumerate(names)}
        self.tree = Tree(t, self.order, self.groups, k, metric, METRICS[metric]) if len(t) >= TREE_ROWS and 0 < t.shape[1] <= TREE_DIMS and metric in POWERS else None

    def ask(self, x: np.ndarray, scale: np.ndarray | None = None, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = None
        if groups is not None:
            codes, names = pd.factorize(groups, use_na_sentinel=False)
            mine = np.array([self.known.get(None if pd.isna(g) else g, -1) for g in names], np.int64)[codes]
        plain = lambda q: all_distances(x[q], self.t, self.order, self.k, self.metric, None if scale is None else scale[q], None if groups is None else (mine[q], self.groups))
        if self.tree is None:
            return plain(slice(None))
        usable = np.ones(len(x), bool) if scale is None else (np.isfinite(scale) & (scale > 0)).all(1)
        if usable.all():
            return self.tree.search(x, scale, mine)
        parts = []
        for q, ask in ((np.flatnonzero(usable), lambda q: self.tree.search(x[q], scale[q], None if mine is None else mine[q])), (np.flatnonzero(~usable & ~np.isnan(scale).any(1)), plain)):
            row, col, d = ask(q)
            parts.append((q[row], col, d))  # a deviation that is no number leaves no distance
        q, r, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        o = np.argsort(q, kind="stable")
        return q[o], r[o], d[o]


def all_distances(x: np.ndarray, t: np.ndarray, order: np.ndarray, k: int, metric: str, scale: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() by the distances of all pairs; `order` is the rows' place among ties."""
    q, r, d = [], [], []
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        parts = [part[:, None, i] - t[None, :, i] for i in range(t.shape[1])]
        if scale is not None:
            parts = [p / scale[lo : lo + 256, None, i] for i, p in enumerate(parts)]
        dist = METRICS[metric](parts)
        if apart is not None:
            dist[apart[0][lo : lo + 256, None] == apart[1][None]] = np.inf
        if dist.shape[1] > k:
            far = np.partition(dist, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(dist <= far[:, None])  # all that tie with the last
        else:
            row, col = np.nonzero(np.ones(dist.shape, bool))
        own = dist[row, col]
        row, col, own = (v[np.isfinite(own)] for v in (row, col, own))
        o = np.lexsort((order[col], own, row))
        row, col, own = row[o], col[o], own[o]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        q.append(row[keep] + lo)
        r.append(col[keep])
        d.append(own[keep])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(q, np.int64), join(r, np.int64), join(d, np.float64)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)[:, :dims] if len(column) else np.zeros((0, dims))


def neighbours(queries: DataFrame, train: DataFrame, k: int, metric: str, dims: int, n_train: int | None = None) -> DataFrame:
    """queries(q, x), train(t, y, x) -> (q, rank, d, t, y) for the k nearest.

    Queries may have `scale`, an array of deviations that their differences are divided by. If both tables have `g`, a
    training row of the query's own g is not compared.
    """
    n = train.count() if n_train is None else n_train
    kinds = {"q": queries.schema["q"], "t": train.schema["t"], "y": train.schema["y"]}
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kinds.items()) + ", d double, rank int"
    types = {c: to_arrow_type(f.dataType) for c, f in kinds.items()}
    scaled, grouped = "scale" in queries.columns, "g" in queries.columns and "g" in train.columns
    asked = queries.select("q", "x", *(["scale"] if scaled else []), *([F.col("g").cast("string").alias("g")] if grouped else []))
    known = train.select("t", "y", "x", *([F.col("g").cast("string").alias("g")] if grouped else []))

    def ready(t: pa.StructArray) -> Nearest:
        return Nearest(_matrix(t.field("x"), dims), t.field("t"), k, metric, t.field("g").to_numpy(zero_copy_only=False) if grouped else None)

    def solve(q: pa.StructArray, t: pa.StructArray, near: Nearest) -> pa.RecordBatch:
        row, col, d = near.ask(_matrix(q.field("x"), dims), _matrix(q.field("scale"), dims) if scaled else None, q.field("g").to_numpy(zero_copy_only=False) if grouped else None)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pa.RecordBatch.from_arrays([q.field("q").take(pa.array(row)).cast(types["q"]), t.field("t").take(pa.array(col)).cast(types["t"]), t.field("y").take(pa.array(col)).cast(types["y"]), pa.array(d), pa.array(rank, pa.int32())], ["q", "t", "y", "d", "rank"])

    if n <= BROADCAST_ROWS:
        rows = known.toArrow().combine_chunks().to_batches()
        shared = queries.sparkSession.sparkContext.broadcast(rows[0].to_struct_array() if rows else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = None
            for batch in batches:
                if shared.value is not None:
                    near = near or ready(shared.value)
                    yield solve(batch.to_struct_array(), shared.value, near)

        return asked.mapInArrow(run, schema)
    n_queries = queries.count()
    block = lambda df, key, n, cols: df.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK)))).alias("block")).agg(F.collect_list(F.struct(*cols)).alias(cols[0])).drop("block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].values
                yield solve(batch.column(0)[i].values, t, ready(t))

    pairs = block(asked, "q", n_queries, asked.columns).crossJoin(block(known, "t", n, known.columns))
    found = pairs.mapInArrow(meet, schema).drop("rank")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "t"))).where(F.col("rank") <= k)


def classified(near: DataFrame, weights: str, keys: Sequence[str] = ("q",)) -> DataFrame:
    """The class of greatest summed weight; ties to the lesser class."""
    votes = near.groupBy(*keys, "y").agg(F.sum(WEIGHTS[weights](F.col("d"))).alias("score"))
    return votes.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "y")).alias("best")).select(*keys, F.col("best.y").alias("pred"))


def regressed(near: DataFrame, weights: str) -> DataFrame:
    w = WEIGHTS[weights](F.col("d"))
    return near.groupBy("q").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("pred"))


def fold_scales(rows: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """(fold, mu, scale): means and deviations of all rows outside each fold, zero deviations as 1; one pass, by total minus part."""
    sums = [F.sum(f).alias(f"s_{f}") for f in features] + [F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features]
    per = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *sums)
    names = [c for c in per.columns if c != fold]
    both = per.crossJoin(F.broadcast(per.agg(*[F.sum(c).alias(f"all_{c}") for c in names])))  # one row of totals
    rest = lambda c: F.col(f"all_{c}") - F.col(c)
    mu = [F.try_divide(rest(f"s_{f}"), rest("n")) for f in features]
    sd = [F.sqrt(F.greatest(F.try_divide(rest(f"q_{f}"), rest("n")) - m * m, F.lit(0.0))) for f, m in zip(features, mu, strict=True)]
    return both.select(fold, F.array(*mu).alias("mu"), F.array(*[F.when(s == 0, 1.0).otherwise(s) for s in sd]).alias("scale"))


def across_folds(rows: DataFrame, key: str, label: str, fold: str, features: Sequence[str], k: int, metric: str, asked: int | None = None) -> DataFrame:
    """(q, rank, d, t, y, truth, fold): the k nearest of every row (of one fold, if `asked`) among the other folds, scaled by their statistics.

    A shift by the mean cancels in a difference, so a row needs no copy for each fold: it brings its fold's deviations.
    """
    points = rows.select(F.col(key).alias("q"), F.col(label).alias("truth"), F.col(fold).alias("g"), F.array(*features).alias("x"))
    scales = fold_scales(rows, fold, features).select(F.col(fold).alias("g"), "scale")
    queries = points if asked is None else points.where(F.col("g") == asked)
    near = neighbours(queries.join(scales, "g").select("q", "x", "scale", "g"), points.select(F.col("q").alias("t"), F.col("truth").alias("y"), "x", "g"), k, metric, len(features))
    return near.join(points.select("q", "truth", F.col("g").alias("fold")), "q")


def grid(near: DataFrame, ks: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """near(q, rank, d, y, truth, fold) for the greatest k -> accuracy by (fold, k, weights): all settings from one list of neighbours.

    A class' score under every setting is a conditional sum, so the neighbours are grouped once.
    """
    settings = [(k, w) for k in ks for w in weights]
    score = lambda k, w: F.round(F.sum(F.when(F.col("rank") <= k, WEIGHTS[w](F.col("d")))), 9)
    votes = near.groupBy("q", "fold", "truth", "y").agg(*[score(k, w).alias(f"s{i}") for i, (k, w) in enumerate(settings)])
    best = [F.min(F.when(F.col(f"s{i}").isNotNull(), F.struct((-F.col(f"s{i}")).alias("s"), "y"))).alias(f"b{i}") for i in range(len(settings))]
    hits = votes.groupBy("q", "fold", "truth").agg(*best).groupBy("fold").agg(*[F.avg((F.col(f"b{i}.y") == F.col("truth")).cast("double")).alias(f"a{i}") for i in range(len(settings))])
    return hits.select("fold", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights"), F.col(f"a{i}").alias("accuracy")) for i, (k, w) in enumerate(settings)])).alias("s")).select("fold", "s.*")


def searched(rows: DataFrame, key: str, label: str, fold: str, features: Sequence[str], ks: Sequence[int] = (1, 3, 5, 7, 9), metrics: Sequence[str] = ("l2", "l1"), weights: Sequence[str] = ("uniform", "distance")) -> DataFrame:
    """(metric, k, weights, accuracy, spread, place): mean and population deviation of accuracy over folds, best first.

    Ties go to the earlier setting in the order of k, metric, weights.
    """
    out = None
    for m in metrics:
        part = grid(across_folds(rows, key, label, fold, features, max(ks), m), ks, weights).withColumn("metric", F.lit(m))
        out = part if out is None else out.unionByName(part)
    scores = out.groupBy("metric", "k", "weights").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("spread"))
    place = lambda name, order: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    # as many rows as there are settings
    return scores.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("accuracy", 9)), "k", place("metric", metrics), place("weights", weights))))
