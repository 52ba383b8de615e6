"""Exact duplicates, near duplicates, repeated passages: against brute force, with awkward rows and none."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm.components import components
from lexiframe.llm.exact_dedup import exact_dedup, normalised
from lexiframe.llm.near_dedup import cell_links, near_dedup, needed
from lexiframe.llm.suffix_array import permuted_lcp, suffix_array
from lexiframe.llm import suffix_array as sa_module
from lexiframe.llm.suffix_dedup import remove_repeats

from .util import brute_exact, brute_near, brute_repeats, edge_docs, edge_rows, got, no_docs, prose, want

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup(spark):
    docs = edge_docs(spark).withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256)).drop("kept")
    rows = [(r[0], r[1]) for r in edge_rows()]
    for slots in (1 << 26, 1, 40):  # crowded bitmaps let rows through, and change nothing
        assert got(exact_dedup(docs, carry=["text_sha256"], slots=slots), *EXACT) == want(brute_exact(rows))
    for hot in (0, 3):  # groups of the broadcast table and groups of the join give the same rows
        assert got(exact_dedup(docs, carry=["text_sha256"], hot=hot), *EXACT) == want(brute_exact(rows))
    assert exact_dedup(no_docs(spark)).count() == 0


def test_exact_dedup_hashes_survivors_only(spark):
    docs = spark.createDataFrame([(i, prose(30 + i % 3, i)) for i in range(30)], "doc_id long, text string")
    assert {r["group_size"] for r in exact_dedup(docs).collect()} == {1}
    assert "Python" not in exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def near_rows():
    r, rows = random.Random(4), []
    for family in range(12):
        base = prose(r.randint(40, 120), 100 + family).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(["edit", "other", "new"])
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_dedup(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = want(brute_near(rows))
    assert got(near_dedup(docs), *NEAR) == expected
    assert got(near_dedup(docs, chunk=2), *NEAR) == expected  # every bucket is split into cells


def hot_rows():
    """Variants of one template in a hot bucket: near copies, chains that only a few members tie, and outsiders."""
    r, rows = random.Random(9), []
    base = prose(120, 77).split()
    for step in range(4):  # each step changes words of the one before: neighbours link, distant ones do not
        for _ in range(9):
            w = list(base)
            w[r.randrange(len(w))] = r.choice(["edit", "other"])
            rows.append((len(rows), " ".join(w)))
        for i in range(3):
            base[(7 + 19 * (3 * step + i)) % 120] = f"step{step}"
    return rows


def test_near_dedup_hot_bucket(spark):
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = want(brute_near(rows))
    for chunk in (12, 5):
        assert got(near_dedup(docs, chunk=chunk), *NEAR) == expected


def test_cell_links_skip_what_is_connected():
    sets = [np.arange(100), np.arange(99), np.arange(98)]
    sigs = np.zeros((3, 10), dtype=np.uint32)
    sizes, side = np.array([100, 99, 98]), np.array([0, 1, 1])
    assert len(cell_links(lambda i: sets[i], sigs, sizes, side, 0, 5, 85, [(10, 0)])) == 2
    assert cell_links(lambda i: sets[i], sigs, sizes, side, 0, 5, 85, [(10, 0)], labels=["x", "x", "y"]) == [(0, 2)]
    assert len(cell_links(lambda i: sets[i], sigs, sizes, side, 0, 5, 85, [(10, 0)], labels=["x", "y", "y"])) == 1


def test_near_dedup_awkward_rows(spark):
    assert got(near_dedup(edge_docs(spark)), *NEAR) == want(brute_near([(r[0], r[1]) for r in edge_rows()]))
    assert near_dedup(no_docs(spark)).count() == 0


def test_near_dedup_crowded_bitmap(spark):
    rows = near_rows()[:18]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(near_dedup(docs, slots=1), *NEAR) == want(brute_near(rows))


def test_pruning_keeps_the_threshold():
    # a pair at the threshold has Binomial(n, 0.85) matches; it is pruned about as often as ``miss`` says
    assert needed(128, 85, 1e-5) < 0.85 * 128
    assert needed(128, 85, 0.5) <= 0.86 * 129
    sets = [np.arange(100, dtype=np.uint64), np.arange(92, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    sigs = np.zeros((3, 10), dtype=np.uint32)
    links = cell_links(lambda i: sets[i], sigs, np.array([100, 92, 100]), np.zeros(3, dtype=int), 0, 5, 85, [(10, 0)])
    assert links == [(0, 1)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(0, i) for i in range(600, 700)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert got(out, "node", "root") == want((n, root(n)) for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alphabet", [1024, 0])
def test_suffix_array(alphabet, monkeypatch):
    monkeypatch.setattr(sa_module, "SMALL_ALPHABET", alphabet)
    r = random.Random(6)
    for _ in range(300):
        k = r.choice([2, 3, 8, 30])
        t = [r.randint(1, k) for _ in range(r.randint(0, 70))]
        if t and r.random() < 0.4:
            t = (t[: r.randint(1, 9)] * 70)[: len(t)]
        t.append(0)
        sa = suffix_array(np.array(t, dtype=np.int32), k + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_permuted_lcp():
    raw = (prose(50, 1) + prose(50, 1) + "x" + prose(20, 2)).encode()
    text = np.frombuffer(raw + bytes(60), dtype=np.uint8)
    sa = suffix_array(np.append(np.frombuffer(raw, dtype=np.uint8).astype(np.int32) + 1, 0), 257)[1:]
    got_ = permuted_lcp(text, sa, 40)
    for i in range(1, len(sa)):
        a, b = bytes(text[sa[i] : sa[i] + 40]), bytes(text[sa[i - 1] : sa[i - 1] + 40])
        assert got_[i] == next((k for k in range(40) if a[k] != b[k]), 40)


SPANS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeat_rows():
    r, rows = random.Random(9), []
    passages = [prose(r.randint(12, 40), 50 + i) for i in range(6)] + ["é" * 70, "ab" * 120, "-" * 260]
    for i in range(60):
        parts = [prose(r.randint(0, 25), 1000 + i)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), prose(r.randint(0, 15), 2000 + 7 * i + len(parts))]
        rows.append((i, " ".join(parts)))
    return rows + [(60, rows[3][1]), (61, rows[3][1])]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "slots": 1 << 15}, {"group_limit": 1}])
def test_remove_repeats(spark, options):
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_repeats([(i, 0, t) for i, t in rows], 100)
    assert got(remove_repeats(docs, **options), *SPANS) == want(expected[i, t] for i, t in rows)


def test_remove_repeats_awkward_rows(spark):
    docs = edge_docs(spark)
    keyed = [(r["doc_id"], r["th"], r["text"]) for r in docs.select("doc_id", F.xxhash64("text").alias("th"), "text").collect()]
    expected = brute_repeats(keyed, 100)
    out = remove_repeats(docs)
    assert got(out, *SPANS) == want(expected[i, t or ""] for i, _, t in keyed)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out.collect())
    assert remove_repeats(no_docs(spark)).count() == 0
