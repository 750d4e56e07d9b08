"""Every query of the engine's own operators by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import spectrum
from ..operators import bayes, kmeans, knn, metrics, model, repeated, scale, search, select
from ..sources import files, media, records
from ..streaming import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Labels, JSON and cleaning

_STEM = r"regexp_replace(regexp_extract(c_name, '[^/]+$'), '(.)\.[^.]*$', '\1')"


@query("label_from_name", f"""
select c_custkey, upper(left(s, 1)) || lower(substr(s, 2)) as label_a, case when b = '' then 'unknown' else b end as label_b, case when c = '' then {_STEM} else c end as label_c, lower(split_part(regexp_extract(c_name, '[^/]+$'), '_', 1)) as word
from (select c_custkey, c_name, regexp_replace(regexp_replace({_STEM}, '[0-9]', '', 'g'), '^[_\\-. ]+|[_\\-. ]+$', '', 'g') as s, regexp_extract(regexp_extract(c_name, '[^/]+$'), '^[A-Za-z]+') as b, regexp_extract({_STEM}, '[A-Za-z]+') as c from customer)""")
def label_from_name(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", X.label_without_digits(n).alias("label_a"), X.label_leading(n).alias("label_b"), X.label_first_letters(n).alias("label_c"), X.word_before_underscore(n).alias("word"))


@query("json_feature_scan", "select event_id, cast(json_extract(props, '$.k') as double) as k, case when json_extract(props, '$.k') is null then 'missing_feature' else 'ok' end as status from events")
def json_feature_scan(spark, d):
    k = F.from_json("props", "k double")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "missing_feature").otherwise("ok").alias("status"))


@query("nan_sanitize", "select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then 0.0 else value end as value from events where value is not null")
def nan_sanitize(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return scale.clean(table(spark, d, "events").where("value is not null").select("event_id", v.alias("value")), ["value"])


@query("finite_guard", """with v as (select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double else value end as value from events where value is not null),
s as (select avg(value) mu, stddev_pop(value) + 1e-8 sd from v where isfinite(value))
select event_id, round(coalesce(case when isfinite(value) then (value - mu) / sd end, -999.0), 6) as z from v, s""")
def finite_guard(spark, d):
    """z-scores where the raw value is finite (-999 stands for the NaN of others); the statistics leave the others out."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").where("value is not null").select("event_id", v.alias("value"))
    return scale.scaled(rows, scale.fit(rows, ["value"], skip_nan=True), ["value"], "eps").select("event_id", r6(F.nanvl("z_value", F.lit(-999.0)), "z"))


# Records of any keys: JSON objects made of events, so that both engines read the same

_JSON = """case event_id % 6 when 0 then '{"label": "' || event_type || '", "k": ' || event_id || ', "z": 1.5}' when 1 then '{"label": null, "class": "other", "k": "text"}' when 2 then '{"class": "' || event_type || '", "k": null}'
when 3 then '{"y": "' || event_type || '", "flag": true, "k": 2.25}' when 4 then '{"z": 2, "label_hint": "tuerca", "k": "7.5"}' else '{"k": ' end"""
_NAME = "'in/ana_' || event_id || '.json'"
_OBJECTS = f"with o as (select event_id, {_NAME} as file, {_JSON} as json from events), v as (select *, json::json as j from o where json_valid(json))"


def _records(spark, d) -> DataFrame:
    return records.parsed(table(spark, d, "events").selectExpr("event_id", f"{_NAME} as file", f"{_JSON} as json"), "json")


def _fields(spark, d) -> DataFrame:
    return _records(spark, d).select("event_id", "file", F.from_json("json", "map<string,string>").alias("fields"))


@query("label_precedence", _OBJECTS + """ select event_id, coalesce(case when list_contains(json_keys(j), 'label') then j->>'label' when list_contains(json_keys(j), 'class') then j->>'class' when list_contains(json_keys(j), 'y') then j->>'y' end, 'ana') as label from v""")
def label_precedence(spark, d):
    return _fields(spark, d).select("event_id", records.label_by_presence(F.col("fields"), F.col("file")).alias("label"))


@query("key_presence_filter", _OBJECTS + " select event_id, json_type(j, '$.k') = 'NULL' as is_null from v where list_contains(json_keys(j), 'label') or list_contains(json_keys(j), 'class') and list_contains(json_keys(j), 'k')")
def key_presence_filter(spark, d):
    """Objects with a label, or with a class and k; a null value is there too."""
    f = F.col("fields")
    return _fields(spark, d).where(records.has_keys(f, ["label"]) | records.has_keys(f, ["class", "k"])).select("event_id", f["k"].isNull().alias("is_null"))


@query("complete_numbers", _OBJECTS + " select event_id, try_cast(j->>'k' as double) as k from v where try_cast(j->>'k' as double) is not null")
def complete_numbers(spark, d):
    return records.with_numbers(_fields(spark, d), "fields", ["k"]).select("event_id", "k")


_KEYS = _OBJECTS + """, e as (select file, unnest(json_keys(j)) as key, j from v), t as (select file, key, json_type(j, '$.' || key) as kind from e),
f as (select key, arg_min(kind, file) as kind from t group by key), n as (select key, kind in ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL') and key not in ('filename', 'label_hint') as is_number from f)"""


@query("union_of_keys", _KEYS + " select key, is_number as numeric from n")
def union_of_keys(spark, d):
    return records.union_of_keys(_records(spark, d)).select("key", "numeric")


@query("feature_union", _KEYS + """ select event_id, coalesce(j->>'label_hint', 'unknown') as label, n.key, coalesce(try_cast(j->>n.key as double), 0.0) as value from v, n where is_number""")
def feature_union(spark, d):
    """Every numeric key of the union for every object, missing ones 0; unpivoted, as which keys there are depends on the data."""
    wide = records.feature_table(_records(spark, d), "event_id")
    names = [c for c in wide.columns if c not in ("file", "event_id", "label")]
    return wide.unpivot(["event_id", "label"], names, "key", "value")


_PATHS = "case event_id % 5 when 0 then 'data/comando/a_' || event_id || '.WAV' when 1 then 'data/img_new/b.jpeg' when 2 then 'comando/old/c.wav' when 3 then 'data/img_new/d.wav' else 'img_new/e.PNG' end"


@query("file_route", f"select event_id, case when split_part(p, '/', -2) = 'comando' and lower(p) like '%.wav' then 'audio' when split_part(p, '/', -2) = 'img_new' and regexp_matches(lower(p), '\\.(jpe?g|png)$') then 'image' end as route from (select event_id, {_PATHS} as p from events)")
def file_route(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{_PATHS} as p").select("event_id", X.route(F.col("p")).alias("route"))


# Scaling

_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _scale_sql(value: str) -> str:
    parts = ", ".join("round(" + value.format(x=c) + f", 6) as z_{c}" for c in _COLS)
    stats = ", ".join(f"avg({c}) mu_{c}, stddev_pop({c}) sd_{c}, min({c}) min_{c}, max({c}) max_{c}" for c in _COLS)
    return f"select l_orderkey, l_linenumber, {parts} from lineitem, (select {stats} from lineitem)"


def _scaled(kind: str) -> Query:
    def run(spark, d):
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in _COLS])
        out = scale.scaled(rows, scale.fit(rows, _COLS, skip_nan=kind == "eps"), _COLS, kind)
        return out.select("l_orderkey", "l_linenumber", *[r6(F.col(f"z_{c}"), f"z_{c}") for c in _COLS])

    return run


query("zscore_pop", _scale_sql("({x} - mu_{x}) / case when sd_{x} = 0 then 1.0 else sd_{x} end"))(_scaled("standard"))
query("zscore_eps", _scale_sql("({x} - mu_{x}) / (sd_{x} + 1e-8)"))(_scaled("eps"))
query("minmax_scale", _scale_sql("case when max_{x} = min_{x} then 0.0 else ({x} - min_{x}) / (max_{x} - min_{x}) end"))(_scaled("minmax"))


# Group statistics


@query("class_counts", "select event_type, count(*) as n from events group by 1")
def class_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_composition_pct", "select g, event_type, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by g), 6) as pct from (select event_type, user_id % 5 as g from events) group by 1, 2")
def cluster_composition_pct(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("g"))
    return metrics.composition(rows, "g", "event_type").withColumn("pct", F.round("pct", 6))


@query("pool_stats", """
select vec_id, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.9), 6) as p90, round(median(x), 6) as median, round(max(x) - min(x), 6) as spread
from (select vec_id, cast(unnest(embedding) as double) as x from embeddings) group by 1""")
def pool_stats(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.transform("embedding", lambda v: v.cast("double"))).alias("x"))
    p = F.percentile("x", F.array(F.lit(0.1), F.lit(0.9), F.lit(0.5)))
    out = rows.groupBy("vec_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), p.alias("p"), (F.max("x") - F.min("x")).alias("w"))
    return out.select("vec_id", r6(F.col("m"), "mean"), r6(F.col("s"), "std"), r6(F.col("p")[0], "p10"), r6(F.col("p")[1], "p90"), r6(F.col("p")[2], "median"), r6(F.col("w"), "spread"))


@query("distance_hist10", """
select vec_id, case when hi = lo then 5 else cast(least(floor((x - lo) / (hi - lo) * 10), 9) as int) end as bin, count(*) as n
from (select vec_id, x, min(x) over (partition by vec_id) lo, max(x) over (partition by vec_id) hi from (select vec_id, cast(unnest(embedding) as double) as x from embeddings)) group by 1, 2""")
def distance_hist10(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.array_min(e).alias("lo"), F.array_max(e).alias("hi"), F.explode(e).alias("x"))
    return rows.select("vec_id", X.bin10(F.col("x"), F.col("lo"), F.col("hi")).alias("bin")).groupBy("vec_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("signal_zcr", "select vec_id, len(list_filter(range(2, 65), lambda i: (embedding[i] >= 0) <> (embedding[i - 1] >= 0))) / 64.0::double as zcr from embeddings")
def signal_zcr(spark, d):
    flips = F.aggregate(F.sequence(F.lit(1), F.size("embedding") - 1), F.lit(0), lambda s, i: s + ((F.get("embedding", i) >= 0) != (F.get("embedding", i - 1) >= 0)).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", (flips / F.size("embedding").cast("double")).alias("zcr"))


_DFT = """with p as (select vec_id, i - 1 as t, cast(embedding[i] as double) as x from embeddings, range(1, 65) r(i)),
m as (select vec_id, k, sqrt(power(sum(x * cos(2 * pi() * k * t / 64)), 2) + power(sum(x * sin(2 * pi() * k * t / 64)), 2)) as mag from p, range(0, 33) f(k) group by 1, 2)"""


@query("signal_dft_dominant", _DFT + """, s as (select vec_id, k, round(mag, 6) as mag from m where k > 0)
select vec_id, cast(min(k) as int) as idx, any_value(s.mag) as mag from s join (select vec_id, max(mag) as mag from s group by 1) b using (vec_id) where s.mag = b.mag group by vec_id""")
def signal_dft_dominant(spark, d):
    """The strongest frequency of each signal; ties to the lowest."""
    return spectrum.dominant(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))).select(F.col("id").alias("vec_id"), "idx", r6(F.col("mag"), "mag"))


@query("highfreq_ratio", _DFT + " select vec_id, round(sum(mag * mag) filter (k >= 26) / sum(mag * mag), 6) as ratio from m group by 1")
def highfreq_ratio(spark, d):
    """Energy in the highest fifth of the frequencies as a share of all."""
    return spectrum.dominant(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))).select(F.col("id").alias("vec_id"), r6(F.col("high"), "ratio"))


@query("hu_transform", "select vec_id, case when v = 0 then 0.0 else round(-sign(v) * log10(abs(v)), 6) end as hu from (select vec_id, cast(embedding[1] as double) as v from embeddings)")
def hu_transform(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(X.hu(F.col("embedding")[0].cast("double")), "hu"))


@query("curvature_max", """
with p as (select vec_id, i, cast(embedding[2 * i + 1] as double) x, cast(embedding[2 * i + 2] as double) y, cast(embedding[2 * ((i + 27) % 32) + 1] as double) px, cast(embedding[2 * ((i + 27) % 32) + 2] as double) py, cast(embedding[2 * ((i + 5) % 32) + 1] as double) nx, cast(embedding[2 * ((i + 5) % 32) + 2] as double) ny from embeddings, range(0, 32) r(i))
select vec_id, round(max(abs((x - px) * (ny - y) - (y - py) * (nx - x)) / (sqrt((x - px) * (x - px) + (y - py) * (y - py)) * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))), 6) as curvature_max,
round(min(degrees(acos(greatest(-1.0, least(1.0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (sqrt((x - px) * (x - px) + (y - py) * (y - py)) * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))))))), 4) as angle_min from p group by 1""")
def curvature_max(spark, d):
    """Each embedding read as a closed polygon of 32 points; curvature proxy and corner angle over steps of 5."""
    n, k = 32, 5
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    at = lambda i: (F.get("e", 2 * (i % n)), F.get("e", 2 * (i % n) + 1))

    def corner(i):
        (x, y), (px, py), (nx, ny) = at(i), at(i + n - k), at(i + k)
        a, b = F.sqrt((x - px) * (x - px) + (y - py) * (y - py)), F.sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))
        curve = F.abs((x - px) * (ny - y) - (y - py) * (nx - x)) / (a * b)
        cosine = ((px - x) * (nx - x) + (py - y) * (ny - y)) / (a * b)
        return F.struct(curve.alias("c"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("a"))

    corners = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner)
    return e.select("vec_id", corners.alias("c")).select("vec_id", r6(F.array_max("c.c"), "curvature_max"), F.round(F.array_min("c.a"), 4).alias("angle_min"))


# Neighbours

_DIMS = (0, 1, 2)
_PREP = """with e as materialized (select vec_id, label, cast(embedding[1] as double) a, cast(embedding[2] as double) b, cast(embedding[3] as double) c from embeddings),
s as materialized (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from e where vec_id % 10 < 7),
z as materialized (select vec_id, label, (a - ma) / sa a, (b - mb) / sb b, (c - mc) / sc c from e, s)"""
_DIST = {"l1": "abs(q.a - t.a) + abs(q.b - t.b) + abs(q.c - t.c)", "l2": "sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c))", "minkowski3": "power(power(abs(q.a - t.a), 3) + power(abs(q.b - t.b), 3) + power(abs(q.c - t.c), 3), 1.0 / 3)"}
_WEIGHT = {"uniform": "1.0::double", "distance": "1.0::double / greatest(d, 1e-12)"}


def _near_sql(metric: str, k: int = 5) -> str:
    return f"""{_PREP}, n as materialized (select q.vec_id q, q.label truth, t.vec_id t, t.label y, {_DIST[metric]} d from z q, z t where q.vec_id % 10 >= 7 and t.vec_id % 10 < 7),
k as materialized (select * from (select *, row_number() over (partition by q order by d, t) r from n) where r <= {k})"""


def _pred_sql(metric: str, weights: str, k: int = 5) -> str:
    return f"""{_near_sql(metric, k)}, v as materialized (select q, truth, y, round(sum({_WEIGHT[weights]}), 9) s from k group by 1, 2, 3),
p as materialized (select q, truth, y as pred from (select *, row_number() over (partition by q order by s desc, y) r from v) where r = 1)"""


def _points(spark, d, dims=_DIMS) -> DataFrame:
    """(id, label, x): chosen dimensions scaled by the training rows' statistics."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in dims])
    names = [f"f{i}" for i in dims]
    z = scale.scaled(e, scale.fit(e.where("vec_id % 10 < 7"), names), names)
    return z.select(F.col("vec_id").alias("id"), "label", F.array(*[f"z_{n}" for n in names]).alias("x"))


def _near(spark, d, metric: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    rows = _points(spark, d)
    train = rows.where("id % 10 < 7").select(F.col("id").alias("t"), F.col("label").alias("y"), "x")
    asked = rows.where("id % 10 >= 7")
    return knn.neighbours(asked.select(F.col("id").alias("q"), "x"), train, k, metric, len(_DIMS)), asked.select(F.col("id").alias("q"), F.col("label").alias("truth"))


def _classify(metric: str, weights: str) -> Query:
    return lambda spark, d: knn.classified(_near(spark, d, metric)[0], weights)


for _m in _DIST:
    for _w in _WEIGHT:
        query(f"knn_{_m}_{_w}", _pred_sql(_m, _w) + " select q, pred from p")(_classify(_m, _w))


def _predictions(spark, d) -> DataFrame:
    near, truth = _near(spark, d, "l1")
    return knn.classified(near, "distance").join(truth, "q").select(F.col("truth").alias("true"), "pred")


@query("knn_accuracy", _pred_sql("l1", "distance") + " select round(avg(cast(truth = pred as double)), 6) as accuracy, count(*) as n from p")
def knn_accuracy(spark, d):
    return metrics.accuracy(_predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("confusion_matrix", _pred_sql("l1", "distance") + ' select truth as "true", ' + ", ".join(f"count(*) filter (pred = {c}) as p{c}" for c in range(10)) + " from p group by 1")
def confusion_matrix(spark, d):
    return metrics.confusion(_predictions(spark, d), list(range(10)))


@query("class_report", _pred_sql("l1", "distance") + """, c as (select l as label, (select count(*) from p where truth = l and pred = l) h, (select count(*) from p where pred = l) n, (select count(*) from p where truth = l) support from (select truth l from p union select pred from p)),
f as (select label, support, case when n = 0 then 0.0::double else h::double / n end pr, case when support = 0 then 0.0::double else h::double / support end re from c),
g as (select *, case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end f1 from f)
select cast(label as varchar) as label, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, support from g
union all select 'accuracy', a, a, a, n from (select round(avg(cast(truth = pred as double)), 6) a, count(*) n from p)
union all select 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), cast(sum(support) as bigint) from g
union all select 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from g""")
def class_report(spark, d):
    return metrics.full_report(_predictions(spark, d)).select("label", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("f1"), "f1"), "support")


@query("knn_regress", _near_sql("l2") + f" select q, round(sum({_WEIGHT['distance']} * y) / sum({_WEIGHT['distance']}), 6) as pred from k group by 1")
def knn_regress(spark, d):
    return knn.regressed(_near(spark, d, "l2")[0], "distance").withColumn("pred", F.round("pred", 6))


@query("knn_rmse", _near_sql("l2") + f", p as (select q, any_value(truth) truth, sum({_WEIGHT['distance']} * y) / sum({_WEIGHT['distance']}) as pred from k group by 1) select round(sqrt(avg((pred - truth) * (pred - truth))), 6) as rmse from p")
def knn_rmse(spark, d):
    near, truth = _near(spark, d, "l2")
    return metrics.rmse(knn.regressed(near, "distance").join(truth, "q").select(F.col("truth").alias("true"), "pred")).withColumn("rmse", F.round("rmse", 6))


_KS = (1, 3, 5, 7, 9)


def _cv_sql(fold: str, metrics=("l1",), ks=(5,), weights=("distance",)) -> str:
    """a(metric, k, weights, part, accuracy): statistics and neighbours of each fold from the others."""
    out = f"""with e as materialized (select vec_id, label, cast(embedding[1] as double) a, cast(embedding[2] as double) b, cast(embedding[3] as double) c, {fold} as fold from embeddings),
f as (select distinct fold from e),
s as materialized (select f.fold, avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from f, e where e.fold <> f.fold group by 1),
z as materialized (select s.fold as part, e.fold, vec_id, label, (a - ma) / sa a, (b - mb) / sb b, (c - mc) / sc c from e, s)"""
    parts = []
    for m in metrics:
        out += f""", n_{m} as materialized (select q.part, q.vec_id q, q.label truth, t.vec_id t, t.label y, {_DIST[m]} d from z q, z t where q.part = t.part and q.fold = q.part and t.fold <> t.part),
k_{m} as materialized (select * from (select *, row_number() over (partition by q order by d, t) r from n_{m}) where r <= {max(ks)})"""
        parts += [f"select '{m}' as metric, {k} as k, '{w}' as weights, part, avg(cast(truth = y as double)) as accuracy from (select part, q, truth, y, row_number() over (partition by q order by round(sum({_WEIGHT[w]}), 9) desc, y) r from k_{m} where r <= {k} group by part, q, truth, y) where r = 1 group by part" for k in ks for w in weights]
    return f"{out}, a as ({' union all '.join(parts)})"


def _folded(spark, d, fold=None, where: str = "true") -> tuple[DataFrame, list[str]]:
    """(vec_id, label, features, fold): five stratified folds, unless one is given."""
    names = [f"f{i}" for i in _DIMS]
    rows = table(spark, d, "embeddings").where(where).select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in zip(_DIMS, names, strict=True)])
    return (files.written(select.stratified_fold(rows, "label", "vec_id", 5)) if fold is None else rows.withColumn("fold", fold)), names


def _cross_validated(spark, d, fold=None) -> DataFrame:
    """Accuracy by fold; a fold's statistics and neighbours come from the others. One plan for any number of folds."""
    rows, names = _folded(spark, d, fold)
    scores = knn.grid(knn.across_folds(rows, "vec_id", "label", "fold", names, 5, "l1"), (5,), ("distance",))
    return scores.select(F.col("fold").cast("int").alias("fold"), r6(F.col("accuracy"), "accuracy"))


_STRATIFIED = "(row_number() over (partition by label order by vec_id) - 1) % 5"


@query("knn_online_predict", """with e as materialized (select vec_id, label, cast(embedding[1] as double) a, cast(embedding[2] as double) b, cast(embedding[3] as double) c from embeddings),
ds as (select avg(a) ma, stddev_pop(a) + 1e-8 sa, avg(b) mb, stddev_pop(b) + 1e-8 sb, avg(c) mc, stddev_pop(c) + 1e-8 sc from e),
z1 as materialized (select vec_id, label, (a - ma) / sa a, (b - mb) / sb b, (c - mc) / sc c from e, ds),
s2 as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from z1 where vec_id % 10 < 7),
z as materialized (select vec_id, label, (a - ma) / sa a, (b - mb) / sb b, (c - mc) / sc c from z1, s2),
n as (select q.vec_id q, t.vec_id t, t.label y, """ + _DIST["l1"] + """ d from z q, z t where q.vec_id % 10 >= 7 and t.vec_id % 10 < 7),
k as (select * from (select *, row_number() over (partition by q order by d, t) r from n) where r <= 5)
select q, y as pred from (select q, y, row_number() over (partition by q order by round(sum(1.0::double / greatest(d, 1e-12)), 9) desc, y) r from k group by q, y) where r = 1""")
def knn_online_predict(spark, d):
    """New rows scaled by the whole dataset's statistics and then by the training rows', asked of the five nearest."""
    names = [f"f{i}" for i in _DIMS]
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in zip(_DIMS, names, strict=True)])
    fitted = model.fit_neighbours(rows.where("id % 10 < 7"), names, dataset=rows)
    return model.ask_neighbours(fitted, rows.where("id % 10 >= 7"))


@query("grid_knn", _cv_sql(_STRATIFIED, ("l2", "l1"), _KS, ("uniform", "distance")) + """, g as (select metric, k, weights, avg(accuracy) accuracy, stddev_pop(accuracy) spread from a group by 1, 2, 3)
select metric, k, weights, round(accuracy, 6) as accuracy, round(spread, 6) as spread, cast(row_number() over (order by round(accuracy, 9) desc, k, metric = 'l1', weights = 'distance') as int) as place from g""")
def grid_knn(spark, d):
    """Twenty settings over five stratified folds, best first."""
    rows, names = _folded(spark, d)
    return knn.searched(rows, "vec_id", "label", "fold", names, _KS).select("metric", "k", "weights", r6(F.col("accuracy"), "accuracy"), r6(F.col("spread"), "spread"), "place")


@query("grid_refit_predict", _cv_sql(_STRATIFIED.replace("_number() over (partition by label", "_number() over (partition by label, vec_id % 10 < 7"), ("l2", "l1"), _KS, ("uniform", "distance")).replace("from embeddings)", "from embeddings where vec_id % 10 < 7)", 1)
+ """, g as (select metric, k, weights, row_number() over (order by round(avg(accuracy), 9) desc, k, metric = 'l1', weights = 'distance') place from a group by 1, 2, 3), w as (select * from g where place = 1),
all_e as (select vec_id, label, cast(embedding[1] as double) a, cast(embedding[2] as double) b, cast(embedding[3] as double) c from embeddings),
st as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from all_e where vec_id % 10 < 7),
zz as materialized (select vec_id, label, (a - ma) / sa a, (b - mb) / sb b, (c - mc) / sc c from all_e, st),
nn as (select q.vec_id q, t.vec_id t, t.label y, case when (select metric from w) = 'l1' then """ + _DIST["l1"] + " else " + _DIST["l2"] + """ end d from zz q, zz t where q.vec_id % 10 >= 7 and t.vec_id % 10 < 7),
kk as (select *, row_number() over (partition by q order by d, t) r from nn)
select q, y as pred from (select q, y, row_number() over (partition by q order by round(sum(case when (select weights from w) = 'uniform' then 1.0::double else 1.0::double / greatest(d, 1e-12) end), 9) desc, y) r from kk where r <= (select k from w) group by q, y) where r = 1""")
def grid_refit_predict(spark, d):
    """The best setting by cross-validation on the training rows, fitted on all of them and asked about the others."""
    rows, names = _folded(spark, d, F.lit(0))
    train = _folded(spark, d, where="vec_id % 10 < 7")[0]
    best = knn.searched(train, "vec_id", "label", "fold", names, _KS).where("place = 1").first()  # one setting
    points = scale.scaled(rows, scale.fit(train, names), names).select(F.col("vec_id").alias("id"), "label", F.array(*[f"z_{n}" for n in names]).alias("x"))
    near = knn.neighbours(points.where("id % 10 >= 7").select(F.col("id").alias("q"), "x"), points.where("id % 10 < 7").select(F.col("id").alias("t"), F.col("label").alias("y"), "x"), best.k, best.metric, len(names))
    return knn.classified(near, best.weights)


@query("stratified_cv_knn", _cv_sql(_STRATIFIED) + " select cast(part as int) as fold, round(accuracy, 6) as accuracy from a")
def stratified_cv_knn(spark, d):
    return _cross_validated(spark, d)


@query("loso_cv_knn", _cv_sql("vec_id % 4") + " select cast(part as int) as fold, round(accuracy, 6) as accuracy from a")
def loso_cv_knn(spark, d):
    return _cross_validated(spark, d, F.col("vec_id") % 4)


@query("stratified_split", "select vec_id, label, (row_number() over (partition by label order by vec_id) - 1) % 10 >= 7 as is_test from embeddings")
def stratified_split(spark, d):
    rows = select.stratified_fold(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 10)
    return rows.select("vec_id", "label", (F.col("fold") >= 7).alias("is_test"))


@query("random_split", "select vec_id, row_number() over (order by ('0x' || substr(md5(vec_id || ':42'), 1, 15))::bigint, vec_id) <= round(0.3 * count(*) over ()) as is_test from embeddings")
def random_split(spark, d):
    """A random permutation's first 30 % against the rest."""
    return select.holdout(table(spark, d, "embeddings").select("vec_id"), "vec_id", 0.3, 42, name="is_test")


_SEEDS = tuple(42 + 17 * i for i in range(5))
_HOLD = "case when row_number() over (partition by label order by ('0x' || substr(md5(vec_id || ':{seed}'), 1, 15))::bigint, vec_id) <= round(0.3 * count(*) over (partition by label)) then 1 else 0 end"


@query("repeated_holdout_knn", " union all ".join(f"select * from ({_cv_sql(_HOLD.format(seed=s))} select {s} as seed, round(accuracy, 6) as accuracy from a where part = 1)" for s in _SEEDS))
def repeated_holdout_knn(spark, d):
    """Accuracy of five stratified hold-outs of 30 %, by seed."""
    names = [f"f{i}" for i in _DIMS]
    rows = table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in zip(_DIMS, names, strict=True)])
    rows = files.written(select.holdouts(rows, "vec_id", 0.3, _SEEDS, "label"))
    scores = repeated.repeated(rows, "vec_id", "label", "held_out", len(_SEEDS), names, 5, "l1")
    return scores.select(F.element_at(F.array(*[F.lit(s) for s in _SEEDS]), F.col("run") + 1).alias("seed"), r6(F.col("accuracy"), "accuracy"))


@query("repeated_holdout_summary", "with r as (" + ORACLE_SQL["repeated_holdout_knn"] + ") select round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std, count(*) as n from r")
def repeated_holdout_summary(spark, d):
    return metrics.spread(repeated_holdout_knn(spark, d), "accuracy").select(r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "n")


@query("round_robin_pick", "select vec_id, label from (select vec_id, label, row_number() over (partition by label order by vec_id) turn from embeddings) order by turn, label limit 25")
def round_robin_pick(spark, d):
    return select.round_robin(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 25).select("vec_id", "label")


# Clusters

_KD = 5
_KSEL = ", ".join(f"cast(embedding[{i + 1}] as double) x{i}" for i in range(_KD))


def _lloyd_sql(iterations: int) -> str:
    d2 = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(_KD))
    means = ", ".join(f"avg(x{i}) x{i}" for i in range(_KD))
    out = f"with p as materialized (select vec_id, label, {_KSEL} from embeddings), c0 as materialized (select row_number() over (order by label) - 1 as k, {', '.join(f'x{i}' for i in range(_KD))} from (select label, {means} from p where label is not null group by 1))"
    for t in range(iterations + 1):
        out += f", a{t} as materialized (select vec_id, label, {', '.join(f'x{i}' for i in range(_KD))}, k, d2 from (select p.*, c.k, {d2} d2, row_number() over (partition by vec_id order by {d2}, c.k) r from p, c{t} c) where r = 1)"
        if t < iterations:
            xs = ", ".join(f"x{i}" for i in range(_KD))
            far = ", ".join(f"x{i} desc" for i in range(_KD))
            # the first empty cluster moves to the farthest point
            out += f", c{t + 1} as materialized (select k, {means} from a{t} group by 1 union all select k, {xs} from (select min(k) k from c{t} where k not in (select k from a{t})), (select {xs} from a{t} order by d2 desc, {far} limit 1) where k is not null)"
    return out


_T = 3


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", X.features(F.col("embedding"), range(_KD)).alias("x"))


def _clustered(spark, d) -> DataFrame:
    """All vectors, clusters begun at the means of all classes."""
    e = _vectors(spark, d)
    return kmeans.assigned(e, kmeans.lloyd(e, kmeans.class_means(e, "label", _KD), _KD, _T, None), _KD)


@query("kmeans_lloyd_3", _lloyd_sql(_T) + f" select vec_id as id, cast(k as int) as cluster, round(d2, 6) as d2 from a{_T}")
def kmeans_lloyd_3(spark, d):
    return _clustered(spark, d).select("id", "cluster", r6(F.col("d2"), "d2"))


@query("kmeans_inertia", _lloyd_sql(_T) + f" select round(sum(d2), 6) as inertia from a{_T}")
def kmeans_inertia(spark, d):
    return _clustered(spark, d).agg(r6(F.sum("d2"), "inertia"))


_MAP = f", v as (select k, label, count(*) n, min(vec_id) first from a{_T} group by 1, 2), m as (select k, label, n, sum(n) over (partition by k) size, row_number() over (partition by k order by n desc, first) r from v)"


@query("cluster_map", _lloyd_sql(_T) + _MAP + " select cast(k as int) as cluster, label, n as majority, cast(size as bigint) as size from m where r = 1")
def cluster_map(spark, d):
    return kmeans.cluster_map(_clustered(spark, d)).select("cluster", "label", "majority", "size")


@query("kmeans_purity", _lloyd_sql(_T) + _MAP + " select round(sum(n) / sum(size)::double, 6) as purity, count(*) = (select count(*) from c0) as complete from m where r = 1")
def kmeans_purity(spark, d):
    classes = table(spark, d, "embeddings").agg(F.countDistinct("label")).first()[0]
    return kmeans.purity(_clustered(spark, d), classes).withColumn("purity", F.round("purity", 6))


@query("kmeans_purity_lenient", _lloyd_sql(_T) + _MAP + " select round(sum(n) / sum(size)::double, 6) as purity from m where r = 1")
def kmeans_purity_lenient(spark, d):
    """Purity over the clusters that have members, whether or not all have."""
    return kmeans.purity(_clustered(spark, d), 0, strict=False).select(r6(F.col("purity"), "purity"))


@query("cluster_names", _lloyd_sql(_T) + _MAP + """ select cast(c0.k as int) as cluster, case when m.label is null then 'desconocido' else 'class_' || m.label end as name from c0 left join (select * from m where r = 1) m on m.k = c0.k
union all select cast((select count(*) from c0) as int), 'desconocido'""")
def cluster_names(spark, d):
    """The name of each cluster's majority in lower case, also of one (the last) that no vector is in."""
    members = _clustered(spark, d).withColumn("label", F.concat(F.lit("CLASS_"), F.col("label").cast("string")))
    classes = table(spark, d, "embeddings").agg(F.countDistinct("label")).first()[0]
    return kmeans.named(kmeans.cluster_map(members), classes + 1)


_PP = f"""with p as materialized (select vec_id, {_KSEL} from embeddings), c as materialized (select vec_id, {', '.join(f'x{i}' for i in range(_KD))} from p where vec_id in (0, 7)),
d as materialized (select p.vec_id, min({' + '.join(f'(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})' for i in range(_KD))}) d2 from p, c group by 1),
r as (select vec_id, d2, sum(d2) over (order by vec_id rows unbounded preceding) as upto, sum(d2) over () as total from d)"""


@query("kmeanspp_init_step", " union all ".join(f"select {u}::double as u, (select min(vec_id) from r where upto >= {u}::double * total) as picked" for u in (0.1, 0.5, 0.9)).join([_PP + " ", ""]))
def kmeanspp_init_step(spark, d):
    """The third start of k-means++ for three given draws: the first row whose running sum of squared distances reaches the draw."""
    e = _vectors(spark, d)
    chosen = [list(r.x) for r in e.where("id in (0, 7)").orderBy("id").select("x").collect()]  # two rows
    return kmeans.draw(kmeans.assigned(e, chosen, _KD), (0.1, 0.5, 0.9))


@query("nearest_centroid_predict", f"""with p as materialized (select vec_id, label, {_KSEL} from embeddings), c as materialized (select dense_rank() over (order by label) - 1 as k, * exclude (label) from (select label, {", ".join(f"avg(x{i}) x{i}" for i in range(_KD))} from p where label is not null group by 1))
select vec_id as id, cast(k as int) as cluster from (select vec_id, k, row_number() over (partition by vec_id order by {" + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(_KD))}, k) r from p, c) where r = 1""")
def nearest_centroid_predict(spark, d):
    e = _vectors(spark, d)
    return kmeans.assigned(e, kmeans.class_means(e, "label", _KD), _KD).select("id", "cluster")


@query("kmeans_best_of_n")
def kmeans_best_of_n(spark, d):
    """Ten k-means++ starts of at most 300 iterations, all runs in one job an iteration; draws are made by numpy, which SQL does not share."""
    e = _vectors(spark, d)
    centroids, _ = kmeans.best_of(e, 4, _KD)
    return kmeans.assigned(e, centroids, _KD).select("id", "cluster")


@query("kmeans_library")
def kmeans_library(spark, d):
    """Clusters of the library's own k-means."""
    return kmeans.library(_vectors(spark, d), 4, _KD).select("id", "cluster")


@query("class_centroids", f"select label, {', '.join(f'round(avg(cast(embedding[{i + 1}] as double)), 6) as c{i}' for i in range(_KD))} from embeddings group by 1")
def class_centroids(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(*[r6(F.avg(F.col("embedding")[i].cast("double")), f"c{i}") for i in range(_KD)])


_CD = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(_KD))


@query("closest_to_centroid", f"""with o as materialized (select vec_id, label, {_KSEL} from embeddings), s as (select {", ".join(f"avg(x{i}) m{i}, stddev_pop(x{i}) s{i}" for i in range(_KD))} from o),
p as materialized (select vec_id, label, {", ".join(f"(x{i} - m{i}) / case when s{i} = 0 then 1.0 else s{i} end x{i}" for i in range(_KD))} from o, s), c as (select label, {", ".join(f"avg(x{i}) x{i}" for i in range(_KD))} from p group by 1)
select label, id, round(distance, 6) as distance, cast(r as int) as rank from (select p.label, vec_id as id, sqrt({_CD}) distance, row_number() over (partition by p.label order by sqrt({_CD}), vec_id) r from p join c on p.label = c.label) where r <= 5""")
def closest_to_centroid(spark, d):
    """The five vectors of each class nearest its mean, in units of all vectors' deviations."""
    names = [f"x{i}" for i in range(_KD)]
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    z = scale.scaled(e, scale.fit(e, names), names).select("id", "label", F.array(*[f"z_{n}" for n in names]).alias("x"))
    return select.closest_to_centroid(z, "label", _KD, 5).withColumn("distance", F.round("distance", 6))


# Feature ranking

_LONG = "with l as (select label, i - 1 as feature, cast(embedding[i] as double) as value from embeddings, range(1, 65) r(i))"
_ANOVA = _LONG + """, c as (select feature, label, count(*) n, avg(value) m, var_pop(value) v from l group by 1, 2),
f as (select feature, ((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as f from c group by 1)"""


def _long(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("feature", "value"))


@query("anova_f", _ANOVA + " select cast(feature as int) as feature, round(f, 6) as f from f")
def anova_f(spark, d):
    return select.anova_f(_long(spark, d), "label").withColumn("f", F.round("f", 6))


@query("top_features", _ANOVA + " select cast(feature as int) as feature, round(f, 6) as f from f order by round(f, 6) desc, feature desc limit 18")
def top_features(spark, d):
    return select.anova_f(_long(spark, d), "label").withColumn("f", F.round("f", 6)).orderBy(F.desc("f"), F.desc("feature")).limit(18)


@query("separability_rank", _LONG + ", c as (select feature, label, avg(value) m, stddev_pop(value) s from l group by 1, 2) select cast(feature as int) as feature, round((max(m) - min(m)) / (avg(s) + 1e-6), 6) as score from c group by 1 order by 2 desc, 1 limit 18")
def separability_rank(spark, d):
    return select.separability(_long(spark, d), "label").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "feature").limit(18)


# Subset searches; their clusters and folds are iterated in numpy by candidate, which SQL does not express


def _searched(spark, d) -> DataFrame:
    """All vectors with as many features as the first one has numbers."""
    e = table(spark, d, "embeddings")
    first = e.select(F.size("embedding").alias("n")).where("n > 0").first()
    return e.select(F.col("vec_id").alias("id"), "label", F.pmod("vec_id", F.lit(5)).alias("fold"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(first.n if first else 0)])


def _pooled(spark, d) -> tuple[DataFrame, list[str]]:
    """All vectors, with the 18 features of greatest ANOVA F."""
    rows = _searched(spark, d)
    names = search.pool(rows, [c for c in rows.columns if c not in ("id", "label", "fold")], "label")
    return rows.select("id", "label", "fold", *names), names


@query("subset_search_kmeans")
def subset_search_kmeans(spark, d):
    """Purity of every pair and triple of the 18 best features, three norms and two weight patterns each."""
    rows, names = _pooled(spark, d)
    found = search.cluster_subsets(rows, names, "label", (2, 3), patterns={"none": {}, "first": {names[0]: 2.5} if names else {}})
    return found.select("no", "norm", "pattern", F.array_join("features", "|").alias("features"), r6(F.col("purity"), "purity"), r6(F.col("inertia"), "inertia"))


@query("subset_search_knn")
def subset_search_knn(spark, d):
    """The best cross-validated accuracies by subset size, of pairs and triples of the 18 best features."""
    rows, names = _pooled(spark, d)
    found = search.best_by_size(search.neighbour_subsets(rows, names, "label", "fold", (2, 3)), "accuracy")
    return found.select("size", "place", F.array_join("features", "|").alias("features"), r6(F.col("accuracy"), "accuracy"), "perfect")


# Events and boxes

_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in X.EVENT_CLASSES.items()) + " end"
_SAMPLE = f"with s as (select user_id, {_CASE} as class from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10), n as (select u.user_id, c.class, c.class_no, (select count(*) from s where s.user_id = u.user_id and s.class = c.class) n from (select distinct user_id from s) u, (values {', '.join(f'({chr(39)}{c}{chr(39)}, {i})' for i, c in enumerate(X.CLASSES))}) c(class, class_no))"
_BOXES = "(values " + ", ".join(f"('{b}', '{c}', {n / 1000.0}::double)" for b, ns in bayes.BOXES.items() for c, n in zip(X.CLASSES, ns, strict=True)) + ") b(model, class, p)"
_POST = f"{_SAMPLE}, l as (select user_id, model, greatest(sum(case when n = 0 then 0 when p = 0 then -1e300 else n * ln(greatest(p, 1e-300)) end), -1e300) ll from n join {_BOXES} on n.class = b.class group by 1, 2), w as (select user_id, model, exp(ll - max(ll) over (partition by user_id)) w from l), post as (select user_id, model, w / sum(w) over (partition by user_id) as posterior from w)"
_PROP = f"{_POST}, prop as (select user_id, b.class, sum(posterior * p) as proportion from post join {_BOXES} on post.model = b.model group by 1, 2)"


def _sample(spark, d) -> DataFrame:
    """(user_id, class, n): classes among each user's last ten events of any type, zeros included."""
    e = table(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 10")
    cls = F.lit(None).cast("string")
    for k, v in X.EVENT_CLASSES.items():
        cls = F.when(F.col("event_type") == k, v).otherwise(cls)
    wide = e.withColumn("class", cls).groupBy("user_id").agg(*[F.count(F.when(F.col("class") == c, 1)).alias(c) for c in X.CLASSES])
    return wide.select("user_id", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in X.CLASSES])).alias("s")).select("user_id", "s.*")


@query("rolling_sample10", _SAMPLE + " select user_id, class, n from n")
def rolling_sample10(spark, d):
    return _sample(spark, d)


@query("bayes_posterior", _POST + " select user_id, model, round(posterior, 6) as posterior from post")
def bayes_posterior(spark, d):
    return bayes.posterior(_sample(spark, d), "user_id").withColumn("posterior", F.round("posterior", 6))


@query("bayes_proportions", _PROP + " select user_id, class, round(proportion, 6) as proportion from prop")
def bayes_proportions(spark, d):
    return bayes.proportions(bayes.posterior(_sample(spark, d), "user_id"), "user_id").select("user_id", "class", r6(F.col("proportion"), "proportion"))


@query("bayes_counts", _PROP + f""", r as (select user_id, class, round(proportion * 1000, 9) raw, case class {" ".join(f"when '{c}' then {i}" for i, c in enumerate(X.CLASSES))} end as class_no from prop),
q as (select *, round_even(raw, 0) r, raw - floor(raw) frac from r), t as (select *, 1000 - sum(r) over (partition by user_id) miss, row_number() over (partition by user_id order by frac desc, class_no) place from q)
select user_id, class, cast(r + case when place <= abs(miss) then sign(miss) else 0 end as bigint) as expected from t""")
def bayes_counts(spark, d):
    return bayes.expected_counts(bayes.proportions(bayes.posterior(_sample(spark, d), "user_id"), "user_id"), "user_id")


@query("event_ring50", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 50")
def event_ring50(spark, d):
    return table(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 50").select("user_id", "event_id", "event_type")


_COUNTS = ", ".join(f"count(case when event_type = '{k}' then 1 end) over w as {v}" for k, v in X.EVENT_CLASSES.items())


@query("rolling_counts10", f"select user_id, event_id, {_COUNTS} from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)")
def rolling_counts10(spark, d):
    """After every event of a user, the classes among the last ten."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("user_id", "event_id", *[F.count(F.when(F.col("event_type") == k, 1)).over(w).alias(v) for k, v in X.EVENT_CLASSES.items()])


# Streams and media


def _folder(spark) -> str:
    """The folder that the cluster shares, or a temporary one where none is set and the master is local."""
    return files.shared_folder(spark)


@query("stream_commands", f"""with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) r, {_CASE} as class from events)
select a.event_id, array_to_string(coalesce(list(b.class order by b.r) filter (b.class is not null), []), ',') as classes from e a left join e b on a.user_id = b.user_id and b.r < a.r and b.r >= a.r - 10 where a.class is null group by a.event_id, a.user_id""")
def stream_commands(spark, d):
    """All events through the keyed log as a stream: each event without a class asks for the classes among the ten before it."""
    source = spark.read.parquet(f"{d}/events.parquet")
    cls = F.lit(None).cast("string")
    for k, v in X.EVENT_CLASSES.items():
        cls = F.when(F.col("event_type") == k, v).otherwise(cls)
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    rows = events.select(F.col("user_id").alias("key"), "event_id", "ts", F.when(cls.isNull(), "audio").otherwise("image").alias("kind"), F.coalesce(cls, "event_type").alias("value"))
    folder = _folder(spark)
    out = log.commands(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", F.array_join("classes", ",").alias("classes"))


def _pictures(spark, d) -> DataFrame:
    """A drawn picture for each vector: a disc or a rectangle, of a size by its id, dark on light."""

    def draw(batches):
        y, x = np.mgrid[:96, :96]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shapes = [(x - 48) ** 2 + (y - 48) ** 2 <= (20 + i % 20) ** 2 if i % 2 else (abs(x - 48) <= 20 + i % 20) & (abs(y - 48) <= 12 + i % 9) for i in ids]
            data = [np.where(s, 30, 220).astype(np.uint8).tobytes() for s in shapes]
            yield pa.RecordBatch.from_arrays([pa.array([f"pieza_{i}.png" for i in ids]), pa.array([96] * len(ids), pa.int32()), pa.array([96] * len(ids), pa.int32()), pa.array(data, pa.binary())], ["file", "height", "width", "gray"])

    return table(spark, d, "embeddings").select("vec_id").mapInArrow(draw, "file string, height int, width int, gray binary")


@query("image_piece_features")
def image_piece_features(spark, d):
    """Masks of drawn pictures and their five shape features."""
    return media.shape_features(media.masks(_pictures(spark, d), 96))


@query("image_shape_features")
def image_shape_features(spark, d):
    """The 77 features of drawn pictures."""
    return media.shape_features(_pictures(spark, d), full=True)


def _sounds(spark, d) -> DataFrame:
    """Each vector as a sound of half a second: its numbers are the strengths of 64 tones."""

    def play(batches):
        t = np.arange(8_000) / 16_000
        tones = np.sin(2 * np.pi * t[None] * (100 + 50 * np.arange(64))[:, None])
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([f"contar_v{i}_1.wav" for i in batch.column(0).to_pylist()]), pa.array((0.2 * x @ tones[: x.shape[1]]).tolist(), pa.list_(pa.float64()))], ["file", "samples"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(play, "file string, samples array<double>")


@query("audio_word_features")
def audio_word_features(spark, d):
    """The three features of words, with their scores in the dataset."""
    return media.with_dataset_scores(media.word_features(_sounds(spark, d)))[0]


@query("audio_voice_features")
def audio_voice_features(spark, d):
    """The 286 numbers of sounds."""
    return media.voice_features(_sounds(spark, d)).select("file", "label", "speaker", "feature_vector", "status")
