import json
from itertools import combinations

import numpy as np
import pytest

from sparkmeld.functions import shapes
from sparkmeld.operators import search
from sparkmeld.plans import catalog


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3], i % 5, float(i % 3 * 10 + rng.normal()), float(rng.normal()), float(i % 3 * 8 + rng.normal()), float(rng.normal())) for i in range(60)]
    return spark.createDataFrame(rows, "id long, label string, fold int, f0 double, f1 double, f2 double, f3 double")


NAMES = ["f0", "f1", "f2", "f3"]


def test_subsets(spark):
    got = [tuple(r.picked) for r in search.subsets(spark, 5, (2, 3)).orderBy("no").collect()]
    assert got == [c for k in (2, 3) for c in combinations(range(5), k)]
    assert search.subsets(spark, 0, (2,)).count() == 0


def test_clusters_of_subsets(points):
    found = search.cluster_subsets(points, NAMES, "label", (2,), patterns={"none": {}, "first": {"f0": 3.0}})
    rows = found.collect()
    assert len(rows) == 6 * 3 * 2
    best = {tuple(r.features) for r in rows if r.purity == 1}
    assert ("f0", "f2") in best and ("f1", "f3") not in best
    assert json.loads(search.summary(found))["total_checked"] == 36


def test_neighbours_of_subsets(points):
    found = search.neighbour_subsets(points, NAMES, "label", "fold", (1, 2))
    rows = {tuple(r.features): r for r in found.collect()}
    assert len(rows) == 10 and rows["f0", "f2"].perfect and rows["f1",].accuracy < 0.7
    top = search.best_by_size(found, "accuracy", 2).collect()
    assert sorted((r.size, r.place) for r in top) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_searches_read_all_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6)], i % 10 if i % 11 < 10 else None) for i in range(110)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog._searched(spark, str(tmp_path)).count() == 110
    found = catalog.QUERIES["subset_search_kmeans"](spark, str(tmp_path)).where("norm = 'none' and pattern = 'none' and features = 'f0|f1'").first()
    x = np.array([r[1][:2] for r in rows], np.float32).astype(float)
    y = np.array([10 if r[2] is None else r[2] for r in rows])  # no label is a class of its own
    own, inertia = search.settle(x, np.stack([x[y == k].mean(0) for k in range(11)]))
    assert (found.purity, found.inertia) == pytest.approx((search.purity(own, y, 11), inertia), abs=1e-6)
    assert catalog.QUERIES["subset_search_knn"](spark, str(tmp_path)).count() == 30


def test_pure_samples(points):
    rows = search.pure_samples(points, ["f0", "f2"], "label", per_class=(50, 12, 10), attempts=6, starts=4).collect()
    assert rows and all(r.per_class == 12 and len(set(r.ids)) == 36 for r in rows)
    assert [r.inertia for r in rows] == sorted(r.inertia for r in rows)


def _holed(points):
    """Some numbers missing or infinite, some rows without a label."""
    return points.selectExpr("id", "if(id % 13 = 0, null, label) label", "fold", "case when id % 7 = 0 then null when id % 11 = 0 then double('infinity') else f0 end f0", "f1", "f2", "f3")


def test_clusters_of_a_table_beyond_the_bound(points, monkeypatch):
    search_ = lambda: {(r.no, r.norm, r.pattern): (r.features, r.purity, r.inertia) for r in search.cluster_subsets(_holed(points), NAMES, "label", (1, 2, 3), patterns={"none": {}, "first": {"f0": 3.0}}).collect()}
    small = search_()
    monkeypatch.setattr(search, "SAMPLE_NUMBERS", 10)
    monkeypatch.setattr(search, "FITS", 50)  # several blocks
    large = search_()
    assert small.keys() == large.keys() and len(small) == 14 * 3 * 2
    for key, (features, purity, inertia) in small.items():
        assert large[key][0] == features and large[key][1:] == pytest.approx((purity, inertia), abs=1e-9)


def test_neighbours_of_a_table_beyond_the_bound(points, monkeypatch):
    search_ = lambda: {tuple(r.features): (r.no, r.accuracy, r.perfect) for r in search.neighbour_subsets(_holed(points), NAMES, "label", "fold", (2,)).collect()}
    small = search_()
    monkeypatch.setattr(search, "SAMPLE_NUMBERS", 10)
    large = search_()
    assert len(small) == 6 and large.keys() == small.keys()
    for key, row in small.items():
        assert large[key] == pytest.approx(row)


def test_accuracy_against_all_distances(points):
    rows = points.orderBy("id").toPandas()
    x, fold = rows[NAMES[:2]].to_numpy(), rows["fold"].to_numpy()
    y = np.unique(rows["label"], return_inverse=True)[1]
    each = []
    for part in range(5):
        test = fold == part
        z = (x - x[~test].mean(0)) / x[~test].std(0)
        hits = 0
        for q, truth in zip(z[test], y[test], strict=True):
            d = np.abs(z[~test] - q).sum(1)
            near = np.argsort(d, kind="stable")[:5]
            hits += np.bincount(y[~test][near], weights=1 / np.maximum(d[near], 1e-12), minlength=3).argmax() == truth
        each.append(hits / test.sum())
    assert search.neighbour_accuracy(x, y, fold) == pytest.approx(np.mean(each))


def test_pool(spark, points):
    assert search.pool(points, NAMES, "label", 2) == ["f0", "f2"]


def test_bound(points, monkeypatch):
    monkeypatch.setattr(search, "SAMPLE_NUMBERS", 10)
    with pytest.raises(ValueError, match="too many"):
        search.pure_samples(points, ["f0", "f2"], "label", per_class=(10,), attempts=1)


def test_enclosing_circle_against_all_circles():
    rng = np.random.default_rng(5)
    for _ in range(20):
        p = shapes.hull(rng.integers(0, 50, (12, 2)))
        c = p[:, 0] + 1j * p[:, 1]
        best = np.inf
        for a, b in combinations(c, 2):
            m, r = (a + b) / 2, abs(a - b) / 2
            best = min(best, r) if (abs(c - m) <= r + 1e-9).all() else best
        for a, b, d in combinations(c, 3):
            s = np.array([[b.real - a.real, b.imag - a.imag], [d.real - a.real, d.imag - a.imag]])
            if abs(np.linalg.det(s)) > 1e-9:
                m = complex(*np.linalg.solve(2 * s, [abs(b) ** 2 - abs(a) ** 2, abs(d) ** 2 - abs(a) ** 2]))
                r = abs(a - m)
                best = min(best, r) if (abs(c - m) <= r + 1e-9).all() else best
        assert shapes.enclosing_radius(p) == pytest.approx(best)


def test_a_subset_compares_a_small_part_of_all_pairs(monkeypatch):
    seen, plain = [0], search.knn.METRICS["l1"]

    def counted(parts):
        out = plain(parts)
        seen[0] += out.size
        return out

    monkeypatch.setitem(search.knn.METRICS, "l1", counted)
    rng = np.random.default_rng(6)
    x, y, fold = rng.normal(size=(12_000, 2)), rng.integers(0, 4, 12_000), np.arange(12_000) % 5
    found = search.neighbour_accuracy(x, y, fold)
    assert seen[0] < 0.05 * 0.8 * len(x) ** 2  # all of them before
    monkeypatch.setattr(search.knn, "TREE_ROWS", 1 << 30)
    assert search.neighbour_accuracy(x, y, fold) == found


def _plain(x, centroids, iterations):
    """Lloyd's iterations with all distances in each."""
    own = None
    for _ in range(iterations):
        d2 = ((x[:, None] - centroids[None]) ** 2).sum(2)
        new = d2.argmin(1)
        if own is not None and (new == own).all():
            break
        own = new
        centroids = np.stack([x[own == k].mean(0) if (own == k).any() else c for k, c in enumerate(centroids)])
    return own, d2.min(1).sum()


def test_settled_as_by_all_distances():
    rng = np.random.default_rng(11)
    for i in range(60):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 9))
        x = rng.integers(0, 4, (n, 2)).astype(float) if i % 3 == 0 else rng.normal(size=(n, 3))
        start = x[rng.integers(0, n, k)] + (5 * rng.normal(size=(k, x.shape[1])) if i % 2 else 0)  # some clusters empty
        for iterations in (300, 1, 4):
            own, inertia = search.settle(x, start, iterations)
            want = _plain(x, start, iterations)
            assert np.array_equal(own, want[0]) and inertia == pytest.approx(want[1])


def test_few_rows_are_compared_again(monkeypatch):
    seen, plain = [], search._compared
    monkeypatch.setattr(search, "_compared", lambda x, c, rows=None: (seen.append(len(x) if rows is None else len(rows)), plain(x, c, rows))[1])
    x = np.random.default_rng(12).normal(size=(20_000, 2))
    search.settle(x, x[:8])
    assert len(seen) > 30 and sum(seen) < 0.5 * len(seen) * len(x)  # all rows in every iteration before
