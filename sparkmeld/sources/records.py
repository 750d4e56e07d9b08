"""Feature records as JSON objects of any keys: labels by key presence, key filters, and a table over the union of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import label_leading

#: Keys that are no features.
NOT_FEATURES = ("filename", "label_hint")
#: Keys that a table may have.
MOST_KEYS = 10_000


def label_by_presence(fields: Column, path: Column) -> Column:
    """The value of the first key of label, class, y that is there; where it is null, or none is there, the name's leading letters.

    A null label hides a class: it is presence that decides, not the value.
    """
    value = F.lit(None).cast("string")
    for key in ("y", "class", "label"):
        value = F.when(F.map_contains_key(fields, key), fields[key]).otherwise(value)
    return F.coalesce(value, label_leading(path))


def has_keys(fields: Column, names: Sequence[str]) -> Column:
    """Whether every key is there, whatever its value."""
    out = F.lit(True)
    for n in names:
        out = out & F.map_contains_key(fields, n)
    return out


def with_numbers(rows: DataFrame, fields: str, names: Sequence[str]) -> DataFrame:
    """Rows that have every key with a value that is a number, with these as double columns, NaN and infinities as 0."""
    from ..functions.exprs import sanitized

    kept = rows.where(has_keys(F.col(fields), names))
    out = kept.select("*", *[F.col(fields)[n].try_cast("double").alias(n) for n in names]).dropna(subset=list(names))
    return out.withColumns({n: sanitized(F.col(n)) for n in names})


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """rows with v, the parsed object; rows whose text is no JSON are left out."""
    return rows.withColumn("v", F.try_parse_json(json)).where(F.col("v").isNotNull())


def union_of_keys(rows: DataFrame) -> DataFrame:
    """rows(file, v) -> (key, kind, numeric): every key with the type of its first value in the order of files; null counts as a number."""
    spark = rows.sparkSession
    each = rows.select("file", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", "key", F.schema_of_variant("value").alias("kind"))
    first = each.where("key is not null").groupBy("key").agg(F.min(F.struct("file", "kind")).alias("f")).select("key", "f.kind")
    numeric = F.col("kind").rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|VOID)$") & ~F.col("key").isin(*NOT_FEATURES)
    return first.select("key", "kind", numeric.alias("numeric"))


def feature_table(rows: DataFrame, *keep: str) -> DataFrame:
    """rows(file, v, ...) -> file, the kept columns, label (label_hint or `unknown`) and every numeric key of the union as a double, missing and null ones 0."""
    names = [r.key for r in union_of_keys(rows).where("numeric").orderBy("key").limit(MOST_KEYS + 1).select("key").collect()]
    if len(names) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    path = lambda n: "$['" + n.replace("'", "\\'") + "']"
    label = F.coalesce(F.try_variant_get("v", "$.label_hint", "string"), F.lit("unknown")).alias("label")
    return rows.select("file", *keep, label, *[F.coalesce(F.try_variant_get("v", path(n), "double"), F.lit(0.0)).alias(n) for n in names])
