"""The fitted models have the reference's parameters; forests read node by node; folds cover every model."""

import dataclasses

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lexiframe.operators import forests as FO
from lexiframe.operators import ml as ML
from lexiframe.operators import models as M


def test_parameters(spark):
    made = {k: (*(m.getOrDefault(p) for p in ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy")), split) for k, (m, split) in ML.forests().items()}
    assert made == {"best_f1": (2000, 30, 2, "sqrt", 45), "best_precision": (2000, 30, 1, "sqrt", 2), "best_recall": (400, 10, 4, "all", 10)}
    b, r = ML.BOOSTED, ML.BOOSTED_REGRESSOR
    assert (b.rounds, b.depth, b.rate, b.positive) == (100, 7, 0.3, 10.0) and (r.rounds, r.leaves, r.least_rows, r.row_share, r.column_share) == (500, 19, 46, 0.75, 0.8)
    g = ML.Grid()
    assert len(g.trees) * len(g.depth) * len(g.least_split) * len(g.least_leaf) * len(g.bootstrap) == 3000
    assert g.trees[0] == 600 and g.trees[-1] == 2000 and g.least_split == (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)


def labelled(spark, n=60):
    r = np.random.default_rng(1)
    rows = [(i, float(i % 3 > 0), Vectors.dense([i % 3 + r.normal() * 0.9, float(r.normal()), float(r.integers(0, 4))]), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, ["article_id", "label", "features", "weight"]).coalesce(1)


def test_forest_nodes(spark):
    """Uncut, the nodes say what the model says; cut at a depth and to the first trees, what that forest would say."""
    t = labelled(spark, 90)
    est = RandomForestClassifier(numTrees=12, maxDepth=6, seed=3, weightCol="weight")
    model = est.fit(t)
    nodes = FO.nodes_of(spark, model)
    want = {r["article_id"]: r["p"] for r in model.transform(t).select("article_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r["article_id"]: r["s"] for r in FO.probabilities(t, nodes, "article_id", 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    rows = t.select("label", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])

    def walk(tree, row, least, depth):
        at, level = nodes.first[tree], 0
        while not nodes.leaf[at] and nodes.rows[at] >= least and level < depth:
            at = nodes.left[at] if row[nodes.feature[at]] <= nodes.threshold[at] else nodes.right[at]
            level += 1
        return nodes.share[at]

    counts = {(r["trees"], r["least_split"], r["depth"]): r for r in FO.grid_counts(t, nodes, [3, 12], [2, 20, 40], [2, 30]).collect()}
    assert len(counts) == 12
    for (n, least, depth), r in counts.items():
        said = np.array([np.mean([walk(k, row, least, depth) for k in range(n)]) > 0.5 for row in x])
        assert (r["tp"], r["pp"], r["ap"], r["right"], r["n"]) == ((said & (y == 1)).sum(), said.sum(), (y == 1).sum(), (said == (y == 1)).sum(), 90)
    assert len({(r["tp"], r["pp"]) for r in counts.values()}) > 1


def small(monkeypatch):
    monkeypatch.setattr(ML, "forests", lambda: {"best_f1": (ML.forest(5, 4, 1, "sqrt"), 4)})
    monkeypatch.setattr(ML, "BOOSTED", dataclasses.replace(ML.BOOSTED, rounds=3))
    monkeypatch.setattr(ML, "BOOSTED_REGRESSOR", dataclasses.replace(ML.BOOSTED_REGRESSOR, rounds=3, least_rows=3))


def test_stacked_and_folds(spark, monkeypatch):
    small(monkeypatch)
    frame = labelled(spark)
    test = frame.filter("article_id >= 45")
    out = {r["article_id"]: r["s"] for r in ML.stacked(frame.filter("article_id < 45"), test, 2).collect()}
    assert sorted(out) == list(range(45, 60)) and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[r["article_id"]] > 0.5) == r["label"] for r in test.collect()]) > 0.6
    data = frame.select(F.col("article_id").alias("id"), "features", (F.col("label") + 1).alias("score"))
    monkeypatch.setattr(ML, "training_frame", lambda s, d: frame)
    monkeypatch.setattr(ML, "regression_frame", lambda s, d: data)
    monkeypatch.setattr(ML, "forest_regressor", lambda: RandomForestRegressor(labelCol="score", numTrees=2))
    monkeypatch.setattr(ML, "REGRESSION_FOLDS", {"rf": 2, "gbt": 3})
    out = {r["model"]: r for r in ML.cross_validate(spark, None, k=2).collect()}
    assert {m: r["folds"] for m, r in out.items()} == {"best_f1": 2, "boosted": 2, "rf_regressor": 2, "gbt_regressor": 3}
    for name, r in out.items():
        assert (r["mean_rmse"] is None) == (not name.endswith("regressor")) and (r["mean_f1"] is None) == name.endswith("regressor")


def test_grid(spark, monkeypatch):
    frame = labelled(spark, 90)
    grid = ML.Grid(trees=(2, 5), depth=(2, 0), least_split=(2, 30), least_leaf=(1, 3), bootstrap=(True,))
    trials = ML.grid_trials(frame, grid, k=3)
    rows = trials.collect()
    assert [r["trial"] for r in sorted(rows, key=lambda r: r["trial"])] == list(range(16))
    assert {(r["trees"], r["depth"], r["least_split"], r["least_leaf"]) for r in rows} == {(n, d, s, a) for n in (2, 5) for d in (2, 0) for s in (2, 30) for a in (1, 3)}
    nodes, best = ML.refit_best(frame, trials)
    assert best["mean_f1"] == max(r["mean_f1"] for r in rows) and len(nodes.first) == best["trees"]
    folds = M.stratified_folds(frame, "label", "article_id", 3).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in folds} == {(0.0, 10), (1.0, 20)}


def test_saved_scorer(spark, tmp_path):
    """Features and forest come back from the folder; names and values of the vectors are those of the long table."""
    rows = [(i, float(i % 2), ("green apple tree " if i % 2 else "paper road stone ") * (1 + i % 3) + f"word{i % 4}", float(i % 5)) for i in range(40)]
    lab = spark.createDataFrame(rows, ["article_id", "label", "text", "size"])
    features, vectors = ML.fit_features(lab, top_k=6)
    names = ML.names_of(vectors)
    assert len(names) == 6 and all(n.startswith(("term:", "feature:")) for n in names)
    long = {(r["article_id"], f"{r['kind']}:{r['name']}"): r["value"] for r in features.long(lab).collect()}
    got = {(r["article_id"], r["name"]): r["value"] for r in ML.named_values(vectors).collect()}
    assert got == {k: v for k, v in long.items() if k[1] in names}
    t = ML.with_weights(vectors)
    model = ML.forest(4, 3, 1, "sqrt").fit(t)
    ML.save_scorer(spark, features, model, 2, f"{tmp_path}/scorer")
    back, nodes, least = ML.load_scorer(spark, f"{tmp_path}/scorer")
    a = FO.probabilities(back.transform(lab), nodes, "article_id", least).collect()
    b = FO.probabilities(vectors, FO.nodes_of(spark, model), "article_id", 2).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 40


def test_anova_counts_zeros(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 4)) * (r.random((30, 4)) < 0.4)
    y = r.integers(0, 2, 30)
    long = spark.createDataFrame([(int(y[i]), f"c{j}", float(x[i, j])) for i in range(30) for j in range(4) if x[i, j]], "label int, name string, value double")
    classes = spark.createDataFrame([(c, int((y == c).sum())) for c in (0, 1)], "label int, nc long")
    got = {q["name"]: q["f_score"] for q in ML.anova_f(long, classes, ["name"], "label", "value").collect()}
    for j in range(4):
        groups = [x[y == c, j] for c in (0, 1)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 28
        assert abs(got[f"c{j}"] - between / within) < 1e-5


def test_forest_in_parts(spark, monkeypatch):
    """A forest of many trees is fitted in parts, none with more trees than the driver is to hold, and has all trees."""
    seen, fit = [], RandomForestClassifier.fit

    def watched(self, *args):
        seen.append((self.getNumTrees(), self.getSeed()))
        return fit(self, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    t = labelled(spark, 60)
    nodes = ML.fit_forest(t, ML.forest(230, 3, 1, "sqrt"))
    assert sorted(n for n, _ in seen) == [30, 100, 100] and len({x for _, x in seen}) == 3 and len(nodes.first) == 230
    assert FO.probabilities(t, nodes, "article_id", 2).count() == 60


def test_forest_grown_in_tasks(spark, monkeypatch):
    """Trees grown in tasks: no fit by MLlib and no nodes in the driver, limits of depth and rows hold, rows of a node are
    those of its children, all features and some of them find the only split there is, and more rows go to MLlib."""
    monkeypatch.setattr(ML, "fit_forest", None)
    r = np.random.default_rng(4)
    rows = [(i, float(i % 4 > 0), Vectors.dense([float(i % 4 > 0) + r.random() / 2, *r.integers(0, 5, 8).astype(float), 0.0]), 1.0 + (i % 4 == 0)) for i in range(120)]
    t = spark.createDataFrame(rows, ["article_id", "label", "features", "weight"])
    for columns, least, depth in (("all", 2, 30), ("sqrt", 12, 30), ("sqrt", 2, 2)):
        nodes = FO.Nodes(ML.forest_nodes(t, ML.forest(23, depth, 3, columns), least).toArrow())
        assert len(nodes.first) == 23
        inner = ~nodes.leaf
        assert (nodes.rows[inner] == nodes.rows[nodes.left[inner]] + nodes.rows[nodes.right[inner]]).all()
        assert nodes.rows[inner].min() >= max(least, 6) and (nodes.rows[nodes.left[inner]] >= 3).all() and (nodes.rows[nodes.right[inner]] >= 3).all()
        if columns == "all":
            assert (nodes.feature[inner] == 0).all() and inner.sum() == 23 and set(nodes.share[nodes.leaf]) == {0.0, 1.0}
    scores = {q["article_id"]: q["s"] for q in ML.forest_scores(t, t, ML.forest(60, 30, 1, "sqrt"), 2).collect()}
    assert len(scores) == 120 and all((s > 0.5) == (i % 4 > 0) for i, s in scores.items())
    with_weight = FO.binned(t)
    assert with_weight.weights == (2.0, 1.0) and with_weight.rows == 120
    monkeypatch.setattr(FO, "WHOLE", 100)
    assert ML.forest_rows(t) is None and ML.forest_nodes(t, ML.forest(3, 2, 1, "sqrt"), 2).select("tree").distinct().count() == 3


def test_fine_edges():
    """A feature that is mostly 0 is cut where it is not."""
    x = np.concatenate((np.zeros(900), np.random.default_rng(3).random(100)))
    e = FO.fine_edges(x, 32)
    assert 25 <= len(e) <= 31 and (np.bincount(np.searchsorted(e, x))[1:] <= 8).all()


def test_compressed_vectors(spark):
    v = [[0.0] * 50, [0.0] * 49 + [2.0], [1.5] * 50]
    meta = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": f"term:{i}"} for i in range(50)]}, "num_attrs": 50}}
    t = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(v)], ["article_id", "features"]).withMetadata("features", meta)
    out = ML.compressed(t)
    got = {r["article_id"]: r["features"] for r in out.collect()}
    assert [got[i].toArray().tolist() for i in range(3)] == v and len(got[1].indices) == 1
    assert ML.names_of(out) == ML.names_of(t) and out.columns == t.columns


def test_linear_fits_read_sparse_rows_over_cores(spark, monkeypatch):
    """Few rows are fitted as they are stored, more of them sparse and in as many tasks as there are cores."""
    seen = []
    monkeypatch.setattr(ML, "linear_scores", lambda train, test, est: (
        seen.append((train.rdd.getNumPartitions(), type(train.first()["features"]).__name__)),
        test.selectExpr("article_id", "0.5D as s"))[1])
    rows = [(i, float(i % 2), Vectors.dense([float(i % 2)] + [0.0] * 30), 1.0) for i in range(40)]
    t = spark.createDataFrame(rows, ["article_id", "label", "features", "weight"]).coalesce(1)
    monkeypatch.setattr(ML, "training_frame", lambda s, d: t)
    assert ML.linear_report(spark, None).count() == 4 and set(seen) == {(1, "DenseVector")}
    seen.clear()
    monkeypatch.setattr(ML.B, "ROWS", 30)
    assert ML.linear_report(spark, None).count() == 4 and set(seen) == {(spark.sparkContext.defaultParallelism, "SparseVector")}
