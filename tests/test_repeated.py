"""Repeated hold-outs in one plan: the rows held out, both ways of finding neighbours against the SQL, and how many jobs they take."""

import duckdb
import numpy as np
import pytest

from sparkmeld.operators import knn, repeated, select
from sparkmeld.plans import catalog

SEEDS = (42, 59)


def test_all_seeds_hold_out_what_each_does(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 7 == 0]) for i in range(900)] + [(1_000, "alone")], "id long, label string")
    got = {r.id: list(r.held_out) for r in select.holdouts(rows, "id", 0.3, SEEDS, "label").collect()}
    for i, seed in enumerate(SEEDS):
        want = {r.id: r.held_out for r in select.holdout(rows, "id", 0.3, seed, "label").collect()}
        assert {k: v[i] for k, v in got.items()} == want


def _table(spark, folder, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_800, 4))
    if kind == "copies":
        x = x[rng.integers(0, 400, len(x))]
    rows = [(i * 3, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), rng.integers(0, 4, len(x)), strict=True))]
    if kind == "nulls":
        rows = [(i, None if i % 7 == 0 else v[:2] if i % 11 == 0 else v, None if i % 5 == 0 else c) for i, v, c in rows]
    if kind == "few":
        rows = [(i, v if i < 24 else None, c) for i, v, c in rows[:40]]
    if kind == "no place":
        rows = [(i, None, c) for i, _, c in rows[:60]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return sorted(con.sql(catalog.ORACLE_SQL["repeated_holdout_knn"]).fetchall())


@pytest.mark.parametrize("bound", [knn.BROADCAST_ROWS, 30])
@pytest.mark.parametrize("kind", ["copies", "nulls", "few", "no place"])
def test_both_ways_give_the_sql(spark, tmp_path, monkeypatch, kind, bound):
    want = _table(spark, tmp_path, kind)
    monkeypatch.setattr(knn, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(repeated, "CELL", 200)
    monkeypatch.setattr(repeated, "ASKED", 100)
    assert len(want) == 5 and sorted(map(tuple, catalog.QUERIES["repeated_holdout_knn"](spark, str(tmp_path)).collect())) == want


def test_five_holdouts_take_few_jobs(spark):
    spark.sparkContext.setJobGroup("holdouts", "")
    try:
        catalog.QUERIES["repeated_holdout_knn"](spark, "/root/testdata/sf0.001").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("holdouts"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 30, jobs


def test_cells_hold_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, 0, [i % 3 == 0], *v) for i, v in enumerate(rng.normal(size=(6_000, 2)).tolist())], "id long, label int, held array<boolean>, f0 double, f1 double")
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 2_000)
    monkeypatch.setattr(repeated, "CELL", 400)
    axes, cuts, low, high = repeated.divided(np.array(rows.select("f0", "f1").collect()), 4)
    x = np.array(rows.where("held[0]").select("f0", "f1").collect())
    cell = repeated._cell(x, axes, cuts)
    assert (np.bincount(cell) < 0.1 * len(x)).all() and low.shape == (2, 16)
    assert all(((low[:, c] <= v) & (v <= high[:, c])).all() for v, c in zip(x, cell, strict=True))
    assert repeated.repeated(rows, "id", "label", "held", 1, ["f0", "f1"], 5, "l2").collect() == [(0, 1.0)]
