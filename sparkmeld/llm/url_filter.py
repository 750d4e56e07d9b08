"""URL filters: host and path rules, then a path-template tree for the URLs that no rule fits.

Per host, segments that look variable (numbers, hex, dates, long mixed tokens) become wildcards at once; literal
segments whose siblings are too many and too rare become wildcards level by level; sibling branches with the same
shape below them whose labelled shares do not differ significantly are merged, from the deepest level up; one without
labels is merged too. A template is rejected when its smoothed
share of labelled bad URLs reaches the threshold. Everything is DataFrame expressions over counts per template, so a
host with a third of all URLs is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

#: The rules that the query applies: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Levels of a path that are templated one by one; what lies deeper is one wildcard.
DEPTH = 6
#: A literal level becomes a wildcard when a branch has this many different segments, each with fewer URLs than RARE on average.
FANOUT, RARE = 30, 3.0
#: A sibling is merged when its labelled share differs from the siblings' by fewer standard errors than this.
SIMILAR_Z = 1.96
#: Prior strength and the least labelled URLs and bad share at which a template is rejected.
STRENGTH, LEAST_LABELLED, REJECT_AT = 4.0, 3, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, ASCII lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as host + path, its verdict), null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later, longer one goes before
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The first DEPTH segments with variable ones as wildcards, and one for all that lie deeper."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: (
        F.when(x.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(x.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(x, r"(\.[A-Za-z]+)$", 1)))
        .when(x.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(x.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.lit("{hex}"))
        .when((F.length(x) > 40) | x.rlike(r"^(?=(?:.*[0-9]){3})[A-Za-z0-9_-]{12,}$"), F.lit("{id}"))
        .otherwise(x)
    )
    kept = F.transform(F.slice(parts, 1, DEPTH), shape)
    return F.when(F.size(parts) > DEPTH, F.concat(kept, F.array(F.lit("{deep}")))).otherwise(kept)


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def templates(urls: DataFrame) -> DataFrame:
    """urls(host, path, bad 1/0/null) -> (host, raw segments, template, n, labelled, bad, seen, purity): one row for each shape of path."""
    rows = urls.select("host", segments(F.col("path")).alias("raw"), F.lit(1).alias("n"), F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    tree = materialize(_sums(rows, "host", "raw").withColumn("t", F.col("raw")), "urls")
    deepest = tree.agg(F.max(F.size("t"))).first()[0] or 0
    for level in range(deepest):  # a branch with too many rare children has a variable there
        above, child = F.concat_ws("/", F.slice("t", 1, level)), F.get("t", F.lit(level))
        wide = (
            tree.select("host", above.alias("above"), child.alias("child"), "n").where("child is not null").groupBy("host", "above", "child").agg(F.sum("n").alias("n"))
            .groupBy("host", "above").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
            .where((F.col("children") >= FANOUT) & (F.col("n") < RARE * F.col("children"))).select("host", "above", F.lit(True).alias("wide"))
        )
        if not wide.isEmpty():
            starred = F.concat(F.slice("t", 1, level), F.array(F.lit("*")), F.slice("t", level + 2, DEPTH + 1))
            new = tree.withColumn("above", above).join(wide, ["host", "above"], "left").withColumn("t", F.when(F.col("wide") & child.isNotNull(), starred).otherwise(F.col("t")))
            new = materialize(new.drop("above", "wide"), "urls")
            discard(tree)
            tree = new
    path = lambda level: F.concat_ws("/", F.slice("t", 1, level), F.array(F.lit("{like}")), F.slice("t", level + 2, DEPTH + 1))
    for level in reversed(range(deepest)):  # merge siblings: the same host and shape with this segment left open
        own = _sums(tree.where(F.size("t") > level), "host", "t").withColumn("open", path(level))
        pool = own.groupBy("host", "open").agg(F.count(F.lit(1)).alias("branches"), F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
        share = F.col("pool_bad") / F.col("pool_labelled")
        error = F.sqrt(F.greatest(share * (1 - share), 0.25 / F.col("pool_labelled")) / F.greatest("labelled", F.lit(1)))
        # a branch without labels differs from none; it joins the labelled ones near the pool, if there are any
        near = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - share) <= SIMILAR_Z * error)
        like = own.join(pool.where("branches > 1 and pool_labelled > 0"), ["host", "open"]).where(near).select("host", "t", F.lit(True).alias("like"))
        if not like.isEmpty():
            joined = F.concat(F.slice("t", 1, level), F.array(F.lit("{like}")), F.slice("t", level + 2, DEPTH + 1))
            new = materialize(tree.join(like, ["host", "t"], "left").withColumn("t", F.when(F.col("like"), joined).otherwise(F.col("t"))).select(*tree.columns), "urls")
            discard(tree)
            tree = new
    tree = tree.withColumn("template", F.concat_ws("/", "t"))
    own = _sums(tree, "host", "template")
    whole = own.agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    prior = F.coalesce((F.col("all_bad") + 1) / (F.col("all_labelled") + 2), F.lit(0.5))
    judged = own.crossJoin(F.broadcast(whole)).select("host", "template", F.col("labelled").alias("seen"), ((F.col("bad") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)).alias("purity"))  # one row of totals
    return tree.select("host", "raw", "template", "n", "labelled", "bad").join(judged, ["host", "template"])


def judge(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls(page_id, url) -> (page_id, host, path, rule, verdict, template, purity).

    Rule verdicts are the labels that templates are judged by. The URLs are joined to the rejected templates only: few,
    and a host's URLs need not meet in one task for it (adaptive execution splits or broadcasts that join).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    at = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    at = at.withColumn("rule", rule).withColumn("ruled", verdict)
    found = templates(at.select("host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("bad")))
    bad = found.where((F.col("seen") >= LEAST_LABELLED) & (F.col("purity") >= REJECT_AT)).select("host", "raw", "template", "purity")
    out = at.withColumn("raw", segments(F.col("path"))).join(bad, ["host", "raw"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url.

    A null url, or one without ://, has an empty host and path, no rule, and is judged as the empty template of the empty
    host. Repeated rows are each judged; an empty table gives no rows. template and purity are null unless rejected.
    """
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
