"""Bayesian model averaging over boxes of known composition, per key, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import CLASSES

#: Pieces of each class (in class order) in a box of 1000, by box.
BOXES = {"a": (250, 250, 250, 250), "b": (150, 300, 300, 250), "c": (250, 350, 250, 150), "d": (500, 500, 0, 0)}
IMPOSSIBLE = -1e300


def boxes(spark: SparkSession) -> DataFrame:
    rows = [f"('{b}', '{c}', {i}, {n / 1000.0}D)" for b, ns in BOXES.items() for i, (c, n) in enumerate(zip(CLASSES, ns, strict=True))]
    return spark.sql(f"select * from values {', '.join(rows)} as t(model, class, class_no, p)")


def posterior(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, class, n), every class once per key -> (key, model, posterior)."""
    part = F.when(F.col("n") == 0, 0.0).when(F.col("p") == 0, IMPOSSIBLE).otherwise(F.col("n") * F.log(F.greatest("p", F.lit(1e-300))))
    like = counts.join(F.broadcast(boxes(counts.sparkSession)), "class").groupBy(key, "model").agg(F.greatest(F.sum(part), F.lit(IMPOSSIBLE)).alias("loglike"))
    shifted = F.exp(F.col("loglike") - F.max("loglike").over(W.partitionBy(key)))
    return like.withColumn("w", shifted).select(key, "model", (F.col("w") / F.sum("w").over(W.partitionBy(key))).alias("posterior"))


def proportions(post: DataFrame, key: str) -> DataFrame:
    return post.join(F.broadcast(boxes(post.sparkSession)), "model").groupBy(key, "class", "class_no").agg(F.sum(F.col("posterior") * F.col("p")).alias("proportion"))


def expected_counts(props: DataFrame, key: str, total: int = 1000) -> DataFrame:
    """Rounded counts whose sum is the total: what is missing or over goes to the greatest fractional parts, one each."""
    x = F.round(F.col("proportion") * total, 9)
    rows = props.withColumn("raw", x).withColumn("r", F.rint("raw")).withColumn("frac", F.col("raw") - F.floor("raw"))
    rows = rows.withColumn("miss", F.lit(total) - F.sum("r").over(W.partitionBy(key)))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("frac"), "class_no")))
    return rows.select(key, "class", (F.col("r") + F.when(F.col("place") <= F.abs("miss"), F.signum("miss")).otherwise(0)).cast("long").alias("expected"))
