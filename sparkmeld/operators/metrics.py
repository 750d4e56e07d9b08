"""Scores of predictions(true, pred), as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accuracy(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("true") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def rmse(p: DataFrame) -> DataFrame:
    return p.agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("true"), F.lit(2.0)))).alias("rmse"))


def confusion(p: DataFrame, classes: list) -> DataFrame:
    """A row per true class, a column per predicted one, in the given order."""
    return p.where(F.col("true").isin(classes)).groupBy("true").agg(*[F.count(F.when(F.col("pred") == c, 1)).alias(f"p{c}") for c in classes])


def report(p: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class that is true or predicted; 0 where undefined."""
    hit = (F.col("true") == F.col("pred")).cast("long")
    sides = p.select(F.col("true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")).unionByName(p.select(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")))
    out = sides.groupBy("label").agg(F.sum("h").alias("h"), F.sum("p").alias("p"), F.sum("t").alias("support"))
    precision, recall = F.coalesce(F.try_divide("h", "p"), F.lit(0.0)), F.coalesce(F.try_divide("h", "support"), F.lit(0.0))
    return out.select("label", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def full_report(p: DataFrame) -> DataFrame:
    """report() with labels as text, then rows `accuracy`, `macro avg` and `weighted avg`."""
    rows = report(p)
    names = ("precision", "recall", "f1")
    averages = rows.agg(F.sum("support").alias("support"), *[F.avg(c).alias(f"macro {c}") for c in names], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted {c}") for c in names])
    means = [averages.select(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind} {c}").alias(c) for c in names], "support") for kind in ("macro", "weighted")]
    hits = accuracy(p).select(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(c) for c in names], F.col("n").alias("support"))
    return rows.withColumn("label", F.col("label").cast("string")).unionByName(hits).unionByName(means[0]).unionByName(means[1])


def spread(scores: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation of repeated scores."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))


def composition(members: DataFrame, group: str, label: str) -> DataFrame:
    """Count and percentage of each label within each group."""
    counts = members.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(group)))
