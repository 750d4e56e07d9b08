"""The tree of boxes against the distances of all pairs, and how many of them it takes."""

import numpy as np
import pyarrow as pa
import pytest

from sparkmeld.operators import knn, tree


def _same(x, t, ids, k, metric, scale=None, apart=None):
    got = knn.nearest(x, t, ids, k, metric, scale, apart)
    want = knn.all_distances(x, t, np.argsort(np.argsort(ids.to_numpy())), k, metric, scale, apart)
    return all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("metric", sorted(knn.METRICS))
@pytest.mark.parametrize("kind", ["normal", "lattice", "copies", "holes", "one place"])
def test_tree_gives_the_nearest_of_all_pairs(kind, metric):
    rng = np.random.default_rng(7)
    for dims, k in ((1, 1), (2, 5), (3, 9)):
        t, x = rng.normal(size=(1_500, dims)), rng.normal(size=(200, dims))
        if kind == "lattice":
            t, x = t.round(1), x.round(1)
        elif kind == "copies":
            t = t[rng.integers(0, 30, len(t))]
            x = t[:200]
        elif kind == "holes":
            t[rng.random(t.shape) < 0.05], x[rng.random(x.shape) < 0.05] = np.nan, np.inf
        elif kind == "one place":
            t[:] = x[:] = 1.5
        ids, scale = pa.array(rng.permutation(len(t))), rng.random((200, dims)) + 0.1
        scale[3] = np.nan if kind == "holes" else 1.0
        names = np.array(["a", "b", None, "c"], object)
        mixed = names[rng.integers(0, 4, len(x))], names[rng.integers(0, 3, len(t))]
        sides = np.nan_to_num(x[:, 0]) > 0, np.nan_to_num(t[:, 0]) > 0  # rows near a query are of its own group
        own = np.arange(len(x)), np.arange(len(t))  # each its own
        for apart in (None, mixed, sides, own):
            assert _same(x, t, ids, k, metric, None, apart) and _same(x, t, ids, k, metric, scale, apart)


@pytest.mark.parametrize("kind", ["normal", "sides", "copies"])
def test_a_small_part_of_all_pairs_is_compared(monkeypatch, kind):
    seen, plain = [0], knn.METRICS["l1"]

    def counted(parts):
        out = plain(parts)
        seen[0] += out.size
        return out

    monkeypatch.setitem(knn.METRICS, "l1", counted)
    rng = np.random.default_rng(8)
    t = rng.normal(size=(20_000, 3))
    if kind == "copies":
        t = t[rng.integers(0, 4, len(t))]
    fold = (t[:, 0] > 0).astype(int) if kind == "sides" else np.arange(len(t)) % 5
    q, _, _ = knn.nearest(t, t, pa.array(np.arange(len(t))), 5, "l1", None, (fold, fold))
    assert (np.bincount(q) == 5).all() and seen[0] < 0.05 * len(t) ** 2  # all of them before


def test_wide_searches_are_split(monkeypatch):
    rng = np.random.default_rng(9)
    t, x = rng.normal(size=(1_500, 2)), rng.normal(size=(300, 2)) * 50  # far away: balls that hold many leaves
    for name, value in (("CHUNK", 64), ("PAIRS", 100)):
        monkeypatch.setattr(tree, name, value)
    assert _same(x, t, pa.array(np.arange(1_500)), 5, "l2")


def test_only_the_held_out_rows_are_asked(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, int(i % 10 < 3), float(i * 37 % 101)) for i in range(200)], "id long, label int, fold int, f0 double")
    asked, plain = [], knn.neighbours
    monkeypatch.setattr(knn, "neighbours", lambda q, *rest: (asked.append(q.count()), plain(q, *rest))[1])
    every = knn.across_folds(rows, "id", "label", "fold", ["f0"], 5, "l1")
    held_out = knn.across_folds(rows, "id", "label", "fold", ["f0"], 5, "l1", asked=1)
    assert asked == [200, 60]
    assert sorted(held_out.collect()) == sorted(every.where("fold = 1").select(*held_out.columns).collect())
