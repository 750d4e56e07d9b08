"""Models, sinks and picture streams, end to end through files."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmeld.functions import spectrum
from sparkmeld.operators import kmeans, knn, metrics, model, scale, search, select
from sparkmeld.sources import files, media
from sparkmeld.streaming import watch


def png(path, x):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + r.tobytes() for r in x.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def pieces(n=240, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, "CDAB"[i % 4], float(rng.normal(4 * (i % 4))), float(rng.normal(-3 * (i % 4))), float(rng.normal(9 * (i % 2)))) for i in range(n)]


def test_models_are_the_same_after_reading(spark, tmp_path):
    rows = spark.createDataFrame(pieces(), "id long, label string, a double, b double, c double")
    train, asked = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    near = model.fit_neighbours(train, ["a", "b", "c"], dataset=rows)
    groups = model.fit_clusters(train, ["a", "b", "c"], 4, runs=3)
    for name, fitted, parts, ask in (("near", near, model.NEIGHBOURS, model.ask_neighbours), ("groups", groups, model.CLUSTERS, model.ask_clusters)):
        files.write_model(fitted, str(tmp_path / name))
        again = files.read_model(spark, str(tmp_path / name), parts)
        assert sorted(ask(again, asked).collect()) == sorted(ask(fitted, asked).collect())
    truth = {r.id: r.label for r in asked.collect()}
    assert np.mean([truth[r.q] == r.pred for r in model.ask_neighbours(near, asked).collect()]) > 0.9
    assert np.mean([truth[r.id].lower() == r.name for r in model.ask_clusters(groups, asked).collect()]) > 0.9


def test_neighbours_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [float(v) for v in rng.integers(0, 4, 3)], f"g{i % 4}") for i in range(300)]  # many ties
    train = spark.createDataFrame(rows, "t long, y int, x array<double>, g string")
    asked = train.select(F.col("t").alias("q"), "x", "g")
    for metric in knn.METRICS:
        for grouped in (False, True):
            q, t = (asked, train) if grouped else (asked.drop("g"), train.drop("g"))
            monkeypatch.setattr(knn, "BROADCAST_ROWS", 131_072)
            small = {(r.q, r["rank"]): (round(r.d, 9), r.t, r.y) for r in knn.neighbours(q, t, 5, metric, 3).collect()}
            monkeypatch.setattr(knn, "BROADCAST_ROWS", 10)
            monkeypatch.setattr(knn, "BLOCK", 64)
            large = {(r.q, r["rank"]): (round(r.d, 9), r.t, r.y) for r in knn.neighbours(q, t, 5, metric, 3).collect()}
            assert small == large and len(small) == 1500
            p = {"l1": 1, "l2": 2, "minkowski3": 3}[metric]
            for i in (0, 17, 299):
                d = sorted((sum(abs(a - b) ** p for a, b in zip(rows[i][2], r[2], strict=True)) ** (1 / p), r[0]) for r in rows if not grouped or r[3] != rows[i][3])
                assert [small[i, k + 1][1] for k in range(5)] == [t for _, t in d[:5]]


def test_empty_clusters_move_apart(spark):
    points = spark.createDataFrame([(i, [float(i // 10), float(i % 10)]) for i in range(100)], "id long, x array<double>")
    ended = kmeans.lloyd(points, [[4.0, 4.0], [900.0, 0.0], [901.0, 0.0], [902.0, 0.0]], 2, 30)
    assert len({tuple(c) for c in ended}) == 4 and kmeans.assigned(points, ended, 2).select("cluster").distinct().count() == 4


def test_draw_is_a_search_in_running_sums(spark):
    rng = np.random.default_rng(3)
    d2 = rng.exponential(size=500)
    near = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d2)], "id long, d2 double")
    us = [0.01, 0.25, 0.5, 0.99]
    got = {r.u: r.picked for r in kmeans.draw(near, us).collect()}
    assert got == {u: int(np.searchsorted(np.cumsum(d2), u * d2.sum())) for u in us}


def test_ranks_within_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 17 == 0 else int(rng.integers(3)), int(rng.integers(50))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, g int, v int")
    got = {r.id: (r.own, r.all) for r in select.ranked(select.ranked(df, "g", "v", "own", tie="id"), None, "v", "all", tie="id").collect()}
    for g in (None, 0, 1, 2):
        own = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i][0] for _, i in own] == list(range(1, len(own) + 1))
    assert [got[i][1] for _, i in sorted((v, i) for i, _, v in rows)] == list(range(1, 2_001))
    held = select.holdout(df, "id", 0.3, 7, "g").groupBy("g").agg(F.sum(F.col("held_out").cast("int")).alias("h"), F.count("*").alias("n")).collect()
    assert all(r.h == int(0.3 * r.n + 0.5) for r in held) and select.ranked(df.limit(0), "g", "v").count() == 0


def test_infinities_are_no_statistics(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    got = [r.z_v for r in scale.scaled(rows, scale.fit(rows, ["v"], skip_nan=True), ["v"], "eps").orderBy("v").collect()]
    assert got[0] is None and got[1:3] == pytest.approx([-1, 1]) and np.isnan(got[3]) and np.isnan(got[4])


def test_spectrum(spark):
    t = np.arange(64)
    rows = [(1, np.cos(2 * np.pi * 5 * t / 64).tolist()), (2, np.cos(2 * np.pi * 30 * t / 64).tolist()), (3, None), (4, [1.0]), (5, [1.0, None, 2.0]), (6, [0.0] * 8)]
    got = {r.id: r for r in spectrum.dominant(spark.createDataFrame(rows, "id long, x array<double>")).collect()}
    assert (got[1].idx, got[2].idx) == (5, 30) and got[1].mag == pytest.approx(32) and got[1].high < 1e-9 and got[2].high == pytest.approx(1)
    assert [got[i].idx for i in (3, 4, 5)] == [None] * 3 and got[6].high == 0


def test_results_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 3 + i / 100), float(i % 5), float(-(i % 3)), i % 3, i % 4) for i in range(60)], "id long, a double, b double, c double, label int, fold int")
    found = search.neighbour_subsets(rows, ["a", "b", "c"], "label", "fold", (1, 2))
    files.write_csv(files.combinations_csv(found, ["a", "b", "c"]), str(tmp_path / "csv"))
    back = {r.indices: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert set(back) == {"0", "1", "2", "0 1", "0 2", "1 2"} and back["0 2"].names == "a|c" and back["2"].accuracy == "1.000000"
    files.write_json(files.perfect_sets(found), str(tmp_path / "perfect"))
    text = next((tmp_path / "perfect").glob("*.json")).read_text()
    assert ["c"] in json.loads(text)["perfect"]["1"]
    files.write_json(files.search_summary(found, "accuracy"), str(tmp_path / "summary"))
    whole = json.loads(next((tmp_path / "summary").glob("*.json")).read_text())
    assert whole["summary"]["total_checked"] == 6 and whole["summary"]["best_accuracy"] == 1 and {"features", "accuracy"} <= whole["results"][0].keys()
    ranked = select.anova_f(rows.select("label", F.posexplode(F.array("a", "b", "c")).alias("feature", "value")), "label")
    pool = files.pool_json(ranked, ["a", "b", "c"], 2).first()
    assert pool.topk == 2 and len(pool.F_scores) == 2 and pool.F_scores[0] >= pool.F_scores[1] and set(pool.names) <= {"a", "b", "c"}
    files.write_statistics(scale.fit(rows, ["a"]), 60, ["a"], str(tmp_path / "stats"))
    stats = json.loads(next((tmp_path / "stats").glob("*.json")).read_text())
    assert stats["count"] == 60 and stats["z_score_stats"]["a"]["mean"] == pytest.approx(np.mean([i % 3 + i / 100 for i in range(60)]))
    files.write_records(rows.withColumn("stem", F.concat(F.lit("v"), F.col("id"))), str(tmp_path / "records"))
    assert len(list((tmp_path / "records").glob("stem=*/*.json"))) == 60
    plot = files.plot_rows(rows.withColumn("file", F.lit("in/Tuerca_ana_1.wav")), ["a", "b", "c"]).first()
    assert (plot.word, plot.x, plot.y) == ("tuerca", 0.0, 0.0)
    assert metrics.spread(found, "accuracy").first().n == 6


def test_pictures_from_folder_to_events(spark, tmp_path):
    folder = tmp_path / "img_new"
    folder.mkdir()
    y, x = np.mgrid[:80, :90]
    for i, (name, shape) in enumerate({"arandela_1.png": (x - 45) ** 2 + (y - 40) ** 2 <= 900, "clavo_2.PNG": (abs(x - 45) < 5) & (abs(y - 40) < 30)}.items()):
        png(folder / name, np.where(shape, 20, 230))
        os.utime(folder / name, (1_700_000_000 + i,) * 2)
    (folder / "broken_3.png").write_bytes(b"no picture")
    seen = {r.file.rsplit("/", 1)[1]: r for r in files.images(spark, str(folder)).collect()}
    assert set(seen) == {"arandela_1.png", "clavo_2.PNG"} and seen["arandela_1.png"].height == 80 and len(seen["clavo_2.PNG"].gray) == 80 * 90

    def classify(batch):
        round_ = media.shape_features(media.masks(files.decoded_images(batch), 90)).where("status = 'ok'")
        return round_.select("file", F.when(F.col("circle_area_ratio") > 0.8, "arandela").otherwise("clavo").alias("value"))

    q = watch.into_table(watch.new_pictures(spark, str(folder)), classify, "image", str(tmp_path / "events"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.schema(watch.EVENT).parquet(str(tmp_path / "events" / "image-0")).orderBy("ts").collect()
    assert [(r.kind, r.value) for r in got] == [("image", "arandela"), ("image", "clavo")]
