"""Feature ranking, folds and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import written


def anova_f(long: DataFrame, label: str) -> DataFrame:
    """F by feature: mean square between classes over that within; 0 where undefined."""
    per = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    out = per.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2.0)) / F.sum("n")).alias("between"),
    )
    f = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return out.select("feature", F.coalesce(f, F.lit(0.0)).alias("f"))


def separability(long: DataFrame, label: str) -> DataFrame:
    """(greatest - least class mean) / (mean class deviation + 1e-6) by feature."""
    per = long.groupBy("feature", label).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return per.groupBy("feature").agg(((F.max("m") - F.min("m")) / (F.avg("s") + 1e-6)).alias("score"))


def ranked(df: DataFrame, group: str | None, order: str, name: str = "rank", parts: int = 64, tie: str | None = None) -> DataFrame:
    """df with the place of each row within its group (of all rows without one) by a number, from 1; ties by `tie`, which has none.

    A window over a whole group would sort it in one task. Rows are numbered within ranges of `order` instead, whose cuts
    are one row for all, and the sizes of the ranges before are added: a hot group is sorted in `parts` tasks.
    """
    cuts = df.select(F.coalesce(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>")).alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda x: x < F.col(order)))).drop("_cuts")  # one row of cuts
    by = ([group] if group else []) + ["_part"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by[:-1]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a group and range
    if group:
        before = before.withColumnRenamed(group, "_group")
        both = rows.join(before.withColumnRenamed("_part", "_p"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))).drop("_group", "_p")
    else:
        both = rows.join(before, "_part")
    place = F.row_number().over(W.partitionBy(*by).orderBy(order, *([tie] if tie else [])))
    return both.withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def stratified_fold(df: DataFrame, label: str, order: str, folds: int, name: str = "fold") -> DataFrame:
    """df with a fold 0..folds-1, dealt in turn within each label."""
    return ranked(df, label, order, name).withColumn(name, F.pmod(F.col(name) - 1, F.lit(folds)))


def digits(key: str, seed: int) -> Column:
    """Fifteen hexadecimal digits that order rows at random: a hash of the key and the seed, the same in every run and engine."""
    return F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15)


def shuffled(key: str, seed: int) -> Column:
    """digits() as a number."""
    return F.conv(digits(key, seed), 16, 10).cast("long")


def holdout(df: DataFrame, key: str, share: float, seed: int, label: str | None = None, name: str = "held_out") -> DataFrame:
    """df with whether a row is in the held-out share of its label (of all rows without one), by a random permutation."""
    rows = ranked(df.withColumn("_h", shuffled(key, seed)), label, "_h", "_r", tie=key)
    sizes = df.groupBy(*([label] if label else [])).agg(F.count(F.lit(1)).alias("_all"))
    if label:
        rows = rows.join(sizes.withColumnRenamed(label, "_label"), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    else:
        rows = rows.crossJoin(F.broadcast(sizes))  # one row
    return rows.withColumn(name, F.col("_r") <= F.round(F.lit(share) * F.col("_all"))).drop("_h", "_r", "_all")


def holdouts(df: DataFrame, key: str, share: float, seeds: Sequence[int], label: str, name: str = "held_out") -> DataFrame:
    """df with an array of whether a row is in the held-out share of its label, as holdout() says, for each seed; in one plan for all. Keys do not repeat.

    Hashes are spread evenly, so ranges of their first two digits are counted, and only the range that the share ends in is
    sorted. They stay hexadecimal: digits of equal number sort as their numbers do.
    """
    hashes = [digits(key, s) for s in seeds]
    long = df.select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.posexplode(F.array(*hashes)).alias("_run", "_h")).withColumn("_part", F.substring("_h", 1, 2))
    sizes = long.groupBy("_l", "_run", "_part").agg(F.count(F.lit(1)).alias("_n"))
    each = W.partitionBy("_l", "_run")  # a row a range, 256 at most
    through = F.sum("_n").over(each.orderBy(F.asc_nulls_last("_part")).rowsBetween(W.unboundedPreceding, 0))
    ends = sizes.withColumn("_before", through - F.col("_n")).withColumn("_left", F.round(F.lit(share) * F.sum("_n").over(each)) - F.col("_before")).where("_left between 1 and _n")
    ends = ends.select(F.col("_l").alias("_label"), F.col("_run").alias("_r"), F.col("_part").alias("_p"), "_left")
    ends = written(ends)  # its size is known from here on: rows are not dealt anew for a few labels
    edge = long.join(ends, F.col("_l").eqNullSafe(F.col("_label")) & (F.col("_run") == F.col("_r")) & (F.col("_part") == F.col("_p")))
    last = edge.withColumn("_place", F.row_number().over(each.orderBy("_h", "_k"))).where("_place = _left")
    cuts = last.groupBy(F.col("_l").alias("_label")).agg(F.map_from_entries(F.collect_list(F.struct("_run", F.struct("_h", "_k").alias("_at")))).alias("_cuts"))  # an entry a seed
    rows = df.join(written(cuts), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    within = [F.coalesce(F.struct(h.alias("_h"), F.col(key).alias("_k")) <= F.try_element_at("_cuts", F.lit(i)), F.lit(False)) for i, h in enumerate(hashes)]
    return rows.withColumn(name, F.array(*within)).drop("_cuts")


def closest_to_centroid(df: DataFrame, label: str, dims: int, top: int) -> DataFrame:
    """(label, id, distance, rank) of the `top` rows nearest their class' mean of x."""
    from ..functions.exprs import l2

    means = df.groupBy(label).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("c"))
    rows = df.join(means, label).withColumn("distance", l2(F.col("x"), F.col("c"), dims))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy("distance", "id"))).where(F.col("rank") <= top).select(label, "id", "distance", "rank")


def round_robin(df: DataFrame, bucket: str, order: str, target: int) -> DataFrame:
    """Rows picked one from each bucket in turn until the target is met."""
    ranked = df.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(order)))
    return ranked.where(F.col("turn") <= target).orderBy("turn", bucket).limit(target)
