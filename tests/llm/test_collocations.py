"""Collocations against SQL and a slow version; the summaries' guarantee."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiframe.llm import collocations as C

from .util import edge_docs, edge_rows, got, lower, no_docs, want

SF = "/root/testdata/sf0.001"
COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(rows, threshold=10, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        found = []
        for p, a in cands.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def test_collocations_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    out = C.op12_collocations(spark, SF)
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5 and out.columns == COLS
    rows = got(out, *COLS)
    assert rows == want(con.execute(f"SELECT {', '.join(COLS)} FROM ({C.SQL})").fetchall()) and len(rows) > 100


@pytest.mark.parametrize("block,mass", [(200, 64), (C.BLOCK, C.MASS)])
def test_collocations_slow(spark, monkeypatch, block, mass):
    monkeypatch.setattr(C, "BLOCK", block)  # tasks take it from the function's module; here the workers' own stays
    monkeypatch.setattr(C, "MASS", mass)
    r = random.Random(5)
    words = "a B c d É ß z\x00 x'y 漢 the".split(" ")
    texts = [(r.choice(["en", "", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "! "]) for _ in range(r.randrange(80))))
             for _ in range(120)]
    texts += [("en", "New York City " * 30), ("en", "new york, city " * 4), ("en", "tick " * 50), (None, None), ("en", ""), ("de", "..,, \t")] * 2
    docs = spark.createDataFrame([(i, lang, t, 7) for i, (lang, t) in enumerate(texts)], "f int, lang string, text string, phrase int").repartition(5)
    assert got(C.collocations(docs, slots=1 << 15), *COLS) == want(slow(texts))
    # a small bitmap, on which all runs meet, changes nothing
    assert got(C.collocations(docs, threshold=3, top=4, slots=1 << 15), *COLS) == want(slow(texts, 3, 4))


def test_collocations_edges(spark):
    assert got(C.collocations(edge_docs(spark)), *COLS) == want(slow([(r[2], r[1]) for r in edge_rows()]))
    assert C.collocations(no_docs(spark)).count() == 0
    assert C.collocations(edge_docs(spark).where("text = ''")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(1, 12))
def test_summaries_keep_what_is_frequent(parts, threshold):
    mass = sum(map(len, parts))
    capacity = mass // threshold + 1
    whole = Counter(x for p in parts for x in p)
    tables = [np.unique(np.array(p, dtype=np.uint32), return_counts=True) for p in parts if p]
    for flush in (1, 1 << 18):
        keys, counts, less = merge_in_steps(tables, capacity, flush)
        assert len(keys) <= capacity and less * (capacity + 1) <= mass
        shown = dict(zip(keys.tolist(), counts.tolist()))
        assert all(shown[x] <= n <= shown[x] + less if x in shown else n <= less for x, n in whole.items())
        assert all(x in shown and shown[x] + less >= threshold for x, n in whole.items() if n >= threshold)


def merge_in_steps(tables, capacity, flush):
    if flush > 1:
        return C.merge(iter(tables), capacity)
    keys, counts, less = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    for t in tables:
        keys, counts, more = C.merge(iter([(keys, counts), t]), capacity)
        less += more
    return keys, counts, less


def test_products_beyond_64_bits(spark):
    big = 40_000_000_000_003
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").selectExpr(f"{C.SCORE} AS s")
    assert df.first()["s"] == 1_000_000 * big * big // ((big + 1) * (big + 2))
