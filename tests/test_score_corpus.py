"""Scoring the corpus: an article's features are made once, vectors are filled in order, edges are cut in many tasks, and
forests are grown and read by the entries that count."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from lexiframe.operators import boosting as B
from lexiframe.operators import forests as FO
from lexiframe.operators import ml as ML
from lexiframe.sources import tables as TB


def tables(spark, d, n):
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(i, f"Der {words[i % 4]} {words[i // 4 % 4]} sagt es. Other!", "en", "p") for i in range(n)]
    for name, rows, schema in [
        ("documents", texts, "doc_id long, text string, lang string, source string"),
        ("labels", [(i, i % 4 // 2, 0) for i in range(0, n, 3)] + [(n - 2, None, 0)], "doc_id long, quality int, toxic int"),
        ("orders", [(i, 1, datetime.datetime(2020, 1, 1)) for i in range(n)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        ("customer", [(1, 0)], "c_custkey long, c_nationkey int"),
        ("nation", [(0, "NATION", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        ("region", [(0, "REGION")], "r_regionkey int, r_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_features_are_made_once(spark, tmp_path, monkeypatch):
    d, n, made, frame = str(tmp_path), 60, [], ML.model_frame
    tables(spark, d, n)
    monkeypatch.setattr(ML, "model_frame", lambda *a: made.append(1) or frame(*a))
    monkeypatch.setattr(ML, "forests", lambda: {"best_f1": (ML.forest(5, 4, 1, "all"), 2)})
    got = {r["article_id"]: r for r in ML.score_corpus(spark, d).collect()}
    assert len(made) == 1 and sorted(got) == list(range(n))
    assert all((r["probability"] > 0.5) == (r["predicted"] == 1) for r in got.values())
    vectors = {r["article_id"]: r["features"].toArray() for r in ML.training_frame(spark, d).collect()}
    own = {r["article_id"]: r["features"].toArray() for r in ML.fit_features(TB.stored(ML.labeled_frame(spark, d), "own"))[1].collect()}
    assert sorted(vectors) == sorted(own) == list(range(0, n, 3))
    assert all(np.allclose(v, own[i], atol=1e-12) for i, v in vectors.items())


def test_vectors_hold_terms_and_numbers_at_their_ranks(spark):
    frame = spark.createDataFrame([(1, 1.0, "aa bb", 3.0, 0.0), (2, 0.0, "aa aa", 0.0, 5.0), (3, None, "", 0.0, 0.0), (4, None, "zz", 7.0, 0.0)],
                                  "article_id long, label double, text string, p double, q double")
    vocabulary = spark.createDataFrame([("aa", 2), ("bb", 1), ("aa bb", 1), ("aa aa", 1)], "term string, df long")
    columns = [("term", "bb"), ("feature", "q"), ("term", "none"), ("term", "aa"), ("feature", "p"), ("term", "left")]
    chosen = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(columns)], "kind string, name string, rank long")
    features = ML.Features(vocabulary, 4, chosen)
    long = features.long(frame)
    value = {(r["article_id"], r["kind"], r["name"]): r["value"] for r in long.collect()}
    for out in (features.transform(frame), features.transform(frame, long)):
        assert {r["article_id"]: r["features"].toArray().tolist() for r in out.collect()} == {i: [value.get((i, *c), 0.0) for c in columns] for i in (1, 2, 3, 4)}
        assert ML.names_of(out) == [f"{k}:{n}" for k, n in columns]
        assert "try_element_at" not in out._jdf.queryExecution().analyzed().toString()  # no search in the entries for each of a thousand places


def test_edges_are_cut_in_many_tasks(spark, tmp_path):
    """More rows than the sample: the limit leaves one task, but the features are dealt out."""
    x = np.random.default_rng(3).integers(0, 40, (300, 24)).astype(float)
    t = spark.createDataFrame([(i, float(i % 2), 0, Vectors.dense(v)) for i, v in enumerate(x)], ["article_id", "label", "fold", "features"])

    def cut_at(values, bins):
        from pyspark import TaskContext
        open(f"{tmp_path}/{TaskContext.get().partitionId()}", "a").close()
        return B.bin_edges(values, bins)

    _, edges, _ = B.prepare(TB.stored(t, "rows"), B.Settings(), "article_id", "label", "fold", "features", sample=280, cut_at=cut_at)
    assert len(edges) == 24 and all(len(e) > 20 for e in edges)
    assert len(list(tmp_path.iterdir())) > 1


@pytest.mark.parametrize("some", [5, 12])
def test_rows_up_to_a_bin(some):
    """Sums by the features' entries, by the nodes' rows and by all cells of a row are those of counting."""
    rng = np.random.default_rng(1)
    d, n, k, width, common = 12, 400, 6, 8, rng.integers(0, 8, 12)
    bins = np.where(rng.random((n, d)) < np.linspace(0.01, 0.9, d), rng.integers(0, width, (n, d)), common)
    blocks = []
    for lo in (0, 150):
        part = bins[lo:n if lo else 150]
        rows = [np.flatnonzero(part[:, f] != common[f]) for f in range(d)]
        blocks.append({"row": np.concatenate(rows).astype(np.int32), "bin": np.concatenate([part[r, f] for f, r in enumerate(rows)]).astype(np.int32),
                       "start": np.cumsum([0, *map(len, rows)]), "y": np.zeros(len(part))})
    t = FO.Table.of(blocks, common, width)
    assert (t.bins(np.repeat(np.arange(n), d), np.tile(np.arange(d), n)).reshape(n, d) == bins).all()
    rows = np.sort(rng.choice(n, 250, replace=False))
    slot = np.sort(rng.choice(k, 250, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02]))
    many, one = rng.integers(1, 4, 250).astype(float), rng.random(250) < 0.3
    features = FO.drawn(rng, k, d, some)
    left, ones = t.up_to(slot, rows, many, one, k, features)
    for i in range(k):
        at = slot == i
        for j, f in enumerate(features[i]):
            for c in range(width - 1):
                low = bins[rows[at], f] <= c
                assert left[i, j, c] == many[at][low].sum() and ones[i, j, c] == (many * one)[at][low].sum()


def test_drawn_features_differ():
    out = FO.drawn(np.random.default_rng(2), 3000, 10, 4)
    assert all(len(set(r)) == 4 for r in out.tolist()) and out.min() == 0 and out.max() == 9
    sets = np.unique(np.sort(out, axis=1), axis=0, return_counts=True)[1]
    assert len(sets) == 210 and sets.max() < 40  # each set equally likely


def test_leaves_of_uneven_trees():
    """Paths of all lengths end where a walk node by node ends, also where a child's number does not follow its sibling's."""
    nodes = [(0, 0, 2, 1, 0, 0.5), (0, 1, -1, -1, -1, 0.0), (0, 2, 4, 3, 1, 0.0), (0, 3, -1, -1, -1, 0.0), (0, 4, -1, -1, -1, 0.0), (1, 0, -1, -1, -1, 0.0)]
    cols = [list(c) for c in zip(*nodes)]
    names = ["tree", "id", "left", "right", "feature", "threshold"]
    own = FO.Nodes(pa.table({**dict(zip(names, cols)), "rows": [1] * 6, "share": [0.0] * 6}))
    x = np.array([[0.5, 0.0], [0.5, 1.0], [0.6, 0.0], [np.nan, 0.0]])
    assert own.leaves(x).tolist() == [[4, 5], [3, 5], [1, 5], [1, 5]]
    assert own.leaves(x[:0]).shape == (0, 2)
