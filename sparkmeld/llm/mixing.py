"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling of documents.

Tokens are summed per cell (source, language, topic). Raking multiplies the cells by one factor per source, language
and topic until each marginal meets its target. A document is drawn once at most, so a cell's probability is bounded by
one: every sweep ends with that bound, and what it cut off stays in the cell's factor product (Dykstra's correction), so
that the sweeps end in the mix nearest to the corpus among those that meet all targets within the bound. A cell's
probability is the product of its three factors, at most one, so only the factors are carried back to the documents.
The mix is as large as the budget and the scarcest value allow. All work on documents is DataFrame expressions. The
cells are raked on the driver while their number is within a bound that is checked, and as a table beyond it: the same
sweeps, the same end.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

MARGINS = ("source", "lang", "topic")
#: Targets: a marginal's share of tokens to this power, renormalised (1 keeps the corpus as it is, 0 makes all equal).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Share of the corpus' tokens that the mix may have at most.
BUDGET = 0.8
#: Sweeps over the margins at most, and the relative error of the bounded mix at which raking ends.
SWEEPS, TOLERANCE = 400, 1e-7
#: The mix is this much smaller than the scarcest value allows, and by SMALLER again when raking does not end: some
#: targets can be met one by one but not together.
SLACK, SMALLER = 0.98, 0.9
#: Cells that are raked on the driver at most.
DRIVER_CELLS = 100_000


#: Characters that topics count, and the one that stands for each of their kind.
KINDS = {"|": "|", "#$%&*": "$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "A", "0123456789": "0"}


def kinds_of(text: Column) -> Column:
    """The text with every counted character replaced by its kind: one pass, after which a kind is a search for one byte."""
    return F.translate(text, "".join(KINDS), "".join(stands * len(chars) for chars, stands in KINDS.items()))


def topic_of(kinds: Column) -> Column:
    """A coarse topic by what a text is made of: table, symbols, capitals, records, prose; empty for none. Takes kinds_of(text)."""
    n = F.length(kinds)
    count = lambda kind: n - F.length(F.replace(kinds, F.lit(kind), F.lit("")))
    return (
        F.when(n == 0, "empty")
        .when(count("|") > n * 0.02, "table")
        .when(count("$") > n * 0.02, "symbols")
        .when(count("A") > n * 0.3, "capitals")
        .when(count("0") > n * 0.1, "records")
        .otherwise("prose")
    )


def described(docs: DataFrame, *kept: Column | str) -> DataFrame:
    """(source, lang, topic, tokens, and the columns `kept`): nulls are the value `unknown`, a null text is empty, tokens are runs of non-space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), kinds_of(text).alias("kinds"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), *kept,
    ).withColumn("kinds", topic_of(F.col("kinds"))).withColumnRenamed("kinds", "topic")


def targets_of(totals: dict[str, float], power: float, given: dict[str, float] | None = None) -> dict[str, float]:
    """Shares of the values with tokens: those given (a value that is not has none), or the totals to a power; renormalised."""
    raised = {k: float(v) ** power if given is None else float(given.get(k, 0.0)) for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole if whole else 1 / len(raised) for k, v in raised.items()}


def size_of(shares: list[dict[str, float]], targets: list[dict[str, float]], budget: float) -> float:
    """Share of the tokens that the mix may have: the budget, or what the scarcest value allows for its target."""
    return min([budget, *(SLACK * share[k] / want for share, target in zip(shares, targets, strict=True) for k, want in target.items() if want > 0)])


def rake(cells: list[tuple], targets: list[dict[str, float]], size: float) -> tuple[list[dict[str, float]], float]:
    """cells: (source, lang, topic, tokens) -> (a factor per value of each margin, largest relative error of a margin).

    A cell's probability is the product of its factors, at most 1; the expected mix is `size` of the tokens.
    """
    cells = [c for c in cells if c[3] > 0]
    names = [list(t) for t in targets]
    place = [{k: i for i, k in enumerate(own)} for own in names]
    at = [np.array([place[m][c[m]] for c in cells], np.int64) for m in range(len(names))]
    share = np.array([c[3] for c in cells], np.float64)
    share /= share.sum()
    want = [np.array([t[k] for k in own]) * size for t, own in zip(targets, names, strict=True)]
    factors = [np.ones(len(own)) for own in names]
    factors[0] *= size
    free, w = share * size, share * size
    error = np.inf
    for _ in range(SWEEPS):
        for m in range(len(names)):
            has = np.bincount(at[m], w, len(names[m]))
            by = np.divide(want[m], has, out=np.zeros_like(has), where=has > 0)
            factors[m] *= by
            w, free = w * by[at[m]], free * by[at[m]]
        w = np.minimum(free, share)
        error = max(float(np.abs(np.bincount(at[m], w, len(names[m])) / np.where(want[m] > 0, want[m], 1) - (want[m] > 0)).max()) for m in range(len(names)))
        if error < TOLERANCE:
            break
    return [dict(zip(own, f.tolist(), strict=True)) for own, f in zip(names, factors, strict=True)], error


def rake_table(cells: DataFrame, targets: DataFrame, size: float) -> tuple[DataFrame, float]:
    """The same sweeps as a table: cells(source, lang, topic, share), targets(margin, value, want) -> (source, lang, topic, prob), error.

    For cells beyond the driver's bound; one written table a sweep.
    """
    wants = {m: targets.where(F.col("margin") == m).select(F.col("value").alias(m), (F.col("want") * size).alias("want")) for m in MARGINS}
    now = materialize(cells.select(*MARGINS, "share", (F.col("share") * size).alias("free"), (F.col("share") * size).alias("w")), "rake")
    error = float("inf")
    for _ in range(SWEEPS):
        nxt = now
        for m in MARGINS:
            by = nxt.groupBy(m).agg(F.sum("w").alias("has")).join(wants[m], m).select(m, F.when(F.col("has") > 0, F.col("want") / F.col("has")).otherwise(0.0).alias("by"))
            nxt = nxt.join(by, m).withColumns({"w": F.col("w") * F.col("by"), "free": F.col("free") * F.col("by")}).drop("by")
        nxt = materialize(nxt.withColumn("w", F.least("free", "share")).select(*now.columns), "rake")
        discard(now)
        now = nxt
        off = [now.groupBy(m).agg(F.sum("w").alias("has")).join(wants[m], m).agg(F.max(F.when(F.col("want") > 0, F.abs(F.col("has") / F.col("want") - 1)).otherwise(F.col("has")))).first()[0] for m in MARGINS]
        error = max(off)
        if error < TOLERANCE:
            break
    return now.select(*MARGINS, (F.col("w") / F.col("share")).alias("prob")), error


def _lookup(spark: SparkSession, factors: dict[str, float], name: str) -> DataFrame:
    """(value, factor) as a table from one literal; at most DRIVER_CELLS rows."""
    literal = F.from_json(F.lit(json.dumps(factors)), "map<string,double>")
    return spark.range(1).select(F.explode(literal).alias(name, f"f_{name}"))


def _fitted(spark: SparkSession, cells: DataFrame, powers: dict[str, float], budget: float, targets: dict[str, dict[str, float]], driver_cells: int) -> tuple[list[DataFrame], Column, float]:
    """(tables to join to the rows on their first columns, prob from their other columns, the mix's share of the tokens)."""
    if cells.count() <= driver_cells:
        got = [(r[0], r[1], r[2], r[3]) for r in cells.where("tokens > 0").collect()]
        totals: list[dict[str, float]] = [{} for _ in MARGINS]
        for c in got:
            for m in range(len(MARGINS)):
                totals[m][c[m]] = totals[m].get(c[m], 0) + c[3]
        want = [targets_of(t, powers[name], targets.get(name)) for t, name in zip(totals, MARGINS, strict=True)]
        whole = sum(totals[0].values())
        size = size_of([{k: v / whole for k, v in t.items()} for t in totals], want, budget)
        if not got:
            return [], F.lit(size), size
        factors, error = rake(got, want, size)
        while error > 1e-3 and size > 1e-6:
            size *= SMALLER
            factors, error = rake(got, want, size)
        tables = [_lookup(spark, f, name) for name, f in zip(MARGINS, factors, strict=True)]
        return tables, F.least(F.col("f_source") * F.col("f_lang") * F.col("f_topic"), F.lit(1.0)), size
    some = cells.where("tokens > 0")
    whole = float(some.agg(F.sum("tokens")).first()[0] or 1)
    shares = materialize(some.select(*MARGINS, (F.col("tokens") / whole).alias("share")), "shares")
    sides = None
    for m in MARGINS:
        total = shares.groupBy(F.col(m).alias("value")).agg(F.sum("share").alias("share"))
        given = targets.get(m)
        if given is None:
            side = total.withColumn("raised", F.pow("share", F.lit(powers[m])))
        else:
            side = total.join(_lookup(spark, given, "value"), "value", "left").select("value", "share", F.coalesce("f_value", F.lit(0.0)).alias("raised"))
        side = side.crossJoin(F.broadcast(side.agg(F.sum("raised").alias("all_raised"), F.count(F.lit(1)).alias("n"))))  # one row of totals
        side = side.select(F.lit(m).alias("margin"), "value", "share", F.when(F.col("all_raised") > 0, F.col("raised") / F.col("all_raised")).otherwise(1 / F.col("n")).alias("want"))
        sides = side if sides is None else sides.unionByName(side)
    sides = materialize(sides, "targets")
    least = sides.where("want > 0").agg(F.min(F.col("share") / F.col("want"))).first()[0]
    size = min(budget, SLACK * (least if least is not None else 1.0))
    probs, error = rake_table(shares, sides, size)
    while error > 1e-3 and size > 1e-6:
        size *= SMALLER
        probs, error = rake_table(shares, sides, size)
    return [probs], F.col("prob"), size


def weighted(spark: SparkSession, rows: DataFrame, *, powers: dict[str, float] = POWERS, budget: float = BUDGET, key: str = "doc_id", targets: dict[str, dict[str, float]] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """rows of described(), written once so that texts are read once, with weight (1 on average over tokens), prob and sampled.

    `targets` gives shares by value for some margins; the others take the corpus' own to a power. The expected mix has
    the target shares and is as large as the budget allows, or as the scarcest value does; targets that can be met one
    by one but not together make it smaller still. A document is sampled when a hash of its key falls below prob, so
    repeated keys share their fate. Documents without tokens weigh nothing in the marginals and have weight 1.
    """
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    tables, prob, size = _fitted(spark, cells, powers, budget, targets or {}, driver_cells)
    names = rows.columns
    for table in tables:  # on the driver's path as many rows as a margin has values: bounded by driver_cells
        on = [c for c in MARGINS if c in table.columns]
        rows = rows.join(F.broadcast(table) if len(tables) > 1 else table, on, "left")
    prob = F.when(F.col("tokens") > 0, F.coalesce(prob, F.lit(size))).otherwise(F.lit(size))
    rows = rows.select(*names, prob.alias("p"))
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.select(*names, (F.col("p") / size).alias("weight"), F.col("p").alias("prob"), (u < F.col("p")).alias("sampled"))


def mixed(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """described() rows of docs with what weighted() adds, and `row`, a struct of all columns of docs."""
    key = settings.pop("key", "doc_id")
    rows = materialize(described(docs, F.col(key).alias("key"), F.struct("*").alias("row")), "described")
    return weighted(spark, rows, key="key", **settings)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, weight, probability (both to six places), and whether it is in the mix.

    Null sources and languages are `unknown`, null texts empty; repeated rows have one cell and fate; other columns are
    not read; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = weighted(spark, materialize(described(docs, "doc_id"), "described"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled")
