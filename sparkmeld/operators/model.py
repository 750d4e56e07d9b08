"""Trained models as tables: neighbours with both scalings, clusters with their names; written, read back and asked about new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmeans, knn, scale

Model = dict[str, DataFrame]

NEIGHBOURS = ("dataset", "scaler", "train", "settings")
CLUSTERS = ("scaler", "centroids", "names", "settings")


def _settings(df: DataFrame, **values) -> DataFrame:
    return df.sparkSession.range(1).select(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in values.items()])


def _twice(rows: DataFrame, dataset: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    """x: features scaled by the dataset's statistics and then by those of the training rows."""
    once = scale.scaled(rows, dataset, names, "eps")
    twice = scale.scaled(once, scaler, [f"z_{n}" for n in names])
    return twice.withColumn("x", F.array(*[f"z_z_{n}" for n in names]))


def fit_neighbours(train: DataFrame, names: Sequence[str], *, id: str = "id", label: str = "label", dataset: DataFrame | None = None, k: int = 5, metric: str = "l1", weights: str = "distance") -> Model:
    """Tables of a classifier: the dataset's statistics (of train by default), the training rows' own, the rows, the settings."""
    base = scale.fit(train if dataset is None else dataset, names, skip_nan=True)
    own = scale.fit(scale.clean(scale.scaled(train, base, names, "eps"), [f"z_{n}" for n in names]), [f"z_{n}" for n in names])
    rows = _twice(train, base, own, names).select(F.col(id).alias("t"), F.col(label).alias("y"), "x")
    return {"dataset": base, "scaler": own, "train": rows, "settings": _settings(train, k=k, metric=metric, weights=weights, names=list(names))}


def ask_neighbours(model: Model, rows: DataFrame, id: str = "id") -> DataFrame:
    """(q, pred) of new rows by the model's own settings."""
    s = model["settings"].first()
    asked = _twice(rows, model["dataset"], model["scaler"], s.names).select(F.col(id).alias("q"), "x")
    return knn.classified(knn.neighbours(asked, model["train"], s.k, s.metric, len(s.names)), s.weights)


def fit_clusters(train: DataFrame, names: Sequence[str], clusters: int, *, id: str = "id", label: str = "label", **settings) -> Model:
    """Tables of a clustering: scaler, centroids, each cluster's name."""
    own = scale.fit(train, names)
    points = scale.scaled(train, own, names).select(F.col(id).alias("id"), F.col(label).alias("label"), F.array(*[f"z_{n}" for n in names]).alias("x"))
    centroids, inertia = kmeans.best_of(points, clusters, len(names), **settings)
    spark = train.sparkSession
    table = spark.range(1).select(F.posexplode(F.array(*[F.array(*map(F.lit, c)) for c in centroids])).alias("cluster", "x"))  # clusters x features numbers
    found = kmeans.named(kmeans.cluster_map(kmeans.assigned(points, centroids, len(names))), clusters)
    return {"scaler": own, "centroids": table, "names": found, "settings": _settings(train, names=list(names), inertia=inertia)}


def ask_clusters(model: Model, rows: DataFrame, id: str = "id") -> DataFrame:
    """(id, cluster, name) of new rows: the nearest centroid and what its cluster is called."""
    names = model["settings"].first().names
    centroids = [list(r.x) for r in model["centroids"].orderBy("cluster").collect()]
    points = scale.scaled(rows, model["scaler"], names).select(F.col(id).alias("id"), F.array(*[f"z_{n}" for n in names]).alias("x"))
    near = kmeans.assigned(points, centroids, len(names)).select("id", "cluster")
    return near.join(F.broadcast(model["names"]), "cluster", "left").select("id", "cluster", F.coalesce("name", F.lit("desconocido")).alias("name"))  # a row a cluster
