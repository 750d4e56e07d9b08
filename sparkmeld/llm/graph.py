"""Connected components of a link table by alternating large-star and small-star contraction.

Nothing is collected: each round is two aggregations with map-side combine and two equi-joins whose skewed side
adaptive execution can split, and its result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _to_least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(u, v) of any orientation, repeats allowed -> (id, component): the least id reachable; only ids with a link to another.

    Self links and rows with a null end are ignored; an empty table gives an empty table.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialize(edges, "cc")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _to_least(both).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _to_least(large)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = edges.groupBy("u").agg(F.min("v").alias("component"))
    return pairs.select(F.col("u").alias("id"), "component").unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())
