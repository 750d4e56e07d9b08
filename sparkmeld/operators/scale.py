"""Scalers: fitted statistics are one row, applied by a one-row broadcast. Standard deviations are of the population."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sanitized


def not_finite(c: str) -> Column:
    return F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))


def fit(df: DataFrame, columns: Sequence[str], skip_nan: bool = False) -> DataFrame:
    """One row: mu_c, sd_c, min_c, max_c of every column; with skip_nan over finite numbers only."""
    out = []
    for c in columns:
        x = F.when(~not_finite(c), F.col(c)) if skip_nan else F.col(c)
        out += [F.avg(x).alias(f"mu_{c}"), F.stddev_pop(x).alias(f"sd_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    return df.agg(*out)


#: Registry: a name stands for an expression of a value and its column's mean, deviation, least and greatest value.
NORMALISERS: dict[str, Callable[..., Column]] = {
    "standard": lambda x, mu, sd, low, high: (x - mu) / F.when(sd == 0, 1.0).otherwise(sd),
    "eps": lambda x, mu, sd, low, high: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(float("nan"))).otherwise((x - mu) / (sd + 1e-8)),
    "minmax": lambda x, mu, sd, low, high: F.when(high == low, 0.0).otherwise((x - low) / F.nullif(high - low, F.lit(0.0))),
    "none": lambda x, mu, sd, low, high: x,
}


def scaled(df: DataFrame, stats: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """standard: zero deviation counts as 1; eps: 1e-8 is added to it, and what is not finite is NaN; minmax: constant columns are 0; none: as they are."""
    rows = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        rows = rows.withColumn(f"z_{c}", NORMALISERS[kind](*(F.col(n) for n in (c, f"mu_{c}", f"sd_{c}", f"min_{c}", f"max_{c}"))))
    return rows.drop(*[f"{p}_{c}" for c in columns for p in ("mu", "sd", "min", "max")])


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sanitized(F.col(c)) for c in columns})
