"""The grid's queries run every setting of the reference, and trees of several limits grown together are those that each grows alone."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexiframe.operators import forests as FO
from lexiframe.operators import ml as ML
from lexiframe.plans.registry import load_all


def labelled(spark, n=60):
    r = np.random.default_rng(1)
    rows = [(i, float(i % 3 > 0), Vectors.dense([i % 3 + r.normal() * 0.9, float(r.normal()), float(r.integers(0, 4))]), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, ["article_id", "label", "features", "weight"]).coalesce(1)


@pytest.mark.parametrize("name", ["grid_tune", "rank_trials", "grid_refit"])
def test_queries_run_every_setting(spark, monkeypatch, name):
    """The trials of the queries are those of the reference's 3,000 settings, and the refit is of the best of them."""
    seen, refit = [], []
    frame = labelled(spark)

    def trials(train, grid, *a, **k):
        seen.append(grid)
        every = [(t, d, s, a, b) for b in grid.bootstrap for d in grid.depth for a in grid.least_leaf for s in grid.least_split for t in grid.trees]
        rows = [(i, *x, *[1.0 if x == (2000, 40, 50, 8, False) else 0.5] * 4) for i, x in enumerate(every)]
        return spark.createDataFrame(rows, "trial long, trees long, depth long, least_split long, least_leaf int, bootstrap boolean, mean_precision double, mean_recall double, mean_f1 double, mean_accuracy double")

    monkeypatch.setattr(ML, "training_frame", lambda s, d: frame)
    monkeypatch.setattr(ML, "grid_trials", trials)
    fit = FO.grow_forests
    monkeypatch.setattr(FO, "grow_forests", lambda rows, trees, depth, limits, *a: (refit.append((trees, depth, limits, a[1])), fit(rows, 3, depth, limits, *a))[1])
    out = load_all()[name][0](spark, f"no folder of {name}").collect()
    assert seen == [ML.Grid()]
    if name == "grid_refit":
        assert refit == [(2000, 40, [(8, 50)], False)] and {r["model"] for r in out} == {"grid_best_f1"}
    else:
        assert len(out) == 3000 and len({(r["trees"], r["depth"], r["least_split"], r["least_leaf"], r["bootstrap"]) for r in out}) == 3000


def test_depths_beyond_thirty_are_grown(spark, monkeypatch):
    """Trees grown in tasks have the depths of the settings, and a fold's least leaves grow together."""
    seen, fit = [], FO.grow_forests
    monkeypatch.setattr(FO, "grow_forests", lambda rows, trees, depth, limits, *a: (seen.append((trees, depth, limits, a[1])), fit(rows, trees, depth, limits, *a))[1])
    rows = ML.grid_trials(labelled(spark, 90), ML.Grid(trees=(2, 4), depth=(20, 40, 0), least_split=(2, 30), least_leaf=(2, 4)), k=2).collect()
    assert sorted(seen) == sorted([(4, ML.UNLIMITED, [(2, 2), (4, 2)], b) for b in (True, False)] * 2)
    assert len(rows) == 48 and sorted(r["trial"] for r in rows) == list(range(48)) and {r["depth"] for r in rows} == {0, 20, 40}


def test_grown_together_as_alone():
    """With all features to choose from a tree depends on its limits and its rows alone: together and alone are the same."""
    rng = np.random.default_rng(5)
    n, d, width, common = 500, 6, 8, np.zeros(6, dtype=np.int64)
    bins = np.where(rng.random((n, d)) < 0.5, rng.integers(0, width, (n, d)), 0)
    y = (bins[:, 0] + bins[:, 1] * (bins[:, 2] > 3) + rng.integers(0, 4, n)) > 6
    rows = [np.flatnonzero(bins[:, f]) for f in range(d)]
    block = {"row": np.concatenate(rows).astype(np.int32), "bin": np.concatenate([bins[r, f] for f, r in enumerate(rows)]).astype(np.int32),
             "start": np.cumsum([0, *map(len, rows)]), "y": y.astype(float)}
    t = FO.Table.of([block], common, width)
    limits = [(1, 2), (2, 5), (4, 5), (8, 40)]
    for bootstrap in (True, False):
        together = FO.grow_alike(t, y, (1.0, 2.0), np.random.default_rng(3), d, 50, limits, bootstrap)
        for one, (leaf, split) in zip(together, limits):
            alone = FO.grow_tree(t, y, (1.0, 2.0), np.random.default_rng(3), d, 50, leaf, split, bootstrap)
            assert all((a == b).all() for a, b in zip(one, alone))
        assert len({len(x[0]) for x in together}) == 4
        some = FO.grow_alike(t, y, (1.0, 2.0), np.random.default_rng(3), 2, 50, limits, bootstrap)
        for (left, right, _, _, count, _), (leaf, split) in zip(some, limits):
            inner = left >= 0
            assert (count[inner] == count[left[inner]] + count[right[inner]]).all() and count[inner].min() >= max(split, 2 * leaf)
            assert count[1:].min() >= leaf and sorted([0, *left[inner], *right[inner]]) == list(range(len(left)))
