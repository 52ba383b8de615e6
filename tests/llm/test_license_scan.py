"""License scan against SQL and a slow version."""

import random
import re

import duckdb

from lexiframe.llm import license_scan as L
from lexiframe.llm.license_rules import BASE, HINT, NAME, NOTICE, TAG, anchor, compiled, required, rules

from .util import edge_docs, edge_rows, got, lower, no_docs, want

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def slow(rows, listed):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        base = [(p, label) for label, phrase in BASE for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        text = "".join(f" {x}:{p} " for p, x in enumerate(w))
        hits = []
        for r in listed:
            for m in re.finditer(compiled(r["words"]), text):
                places = re.findall(r":(\d+) ", m[0])
                hits.append((int(places[0]), int(places[-1]) + 1, r["kind"], r["rule"], r["label"], r["weight"], r["base"]))
        left = [h for h in hits if h[6] or not any(
            o is not h and o[0] <= h[0] and o[1] >= h[1] and o[2] <= h[2] and (o[:2] != h[:2] or o[2:4] < h[2:4]) for o in hits)]
        out.append((i, len(w), len(base), min(base, default=(None,))[0], max(base, default=(None,))[0], ",".join(sorted({b for _, b in base})),
                    ",".join(sorted({h[4] for h in left})), max((h[5] for h in left), default=0.0)))
    return out


def test_license_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    out = L.op11_license_scan(spark, SF)
    assert out.columns == COLS and [t for _, t in out.dtypes] == ["bigint"] * 5 + ["string"] * 2 + ["double"]
    rows = got(out, *COLS)
    assert rows == want(con.execute(L.QUERIES["op11_license_scan"][1]).fetchall())
    assert sum(r[2] > 0 for r in rows) > 20 and sum(r[6] == "" for r in rows) > 900
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) for r in rows)


SAID = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache,apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT\nLicense. MIT license; mit-license! permit license", "mit"),
    ("Dual licence: see the three-clause BSD licence", "bsd-3-clause"),
    ("made available under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("Copyright (c) 2020 The Firm. All rights reserved.", "proprietary"),
    ("under the Mozilla Public License v. 2.0.", "mpl"),
    ("walks with a green apple under the table", ""),
    ("Released under the MPL 2.0", ""),
    ("licensed under the MPL 2.0", "mpl-2.0"),
]


def test_license_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string")
    assert [r["labels"] for r in L.license_scan(docs).orderBy("doc_id").collect()] == [x for _, x in SAID]
    spans = {r["doc_id"]: [(s["start"], s["end"], s["label"]) for s in r["spans"]] for r in L.license_scan(docs).collect()}
    assert spans[0] == [(0, 8, "apache-2.0")] and spans[1] == [(0, 8, "gpl-2.0-or-later")]


def test_license_slow(spark):
    r, listed = random.Random(3), rules()
    words = ("the of MIT license general public License apache version 2 3 0 gnu under licensed released lgpl terms É漢 x cc by sa nc 4 copyright all rights "
             "reserved spdx identifier gpl creative commons attribution sharealike bsd clause two").split()
    texts = [" ".join(r.choice(words) + r.choice(["", "", ".", "-", "\n", " ", " \0"]) for _ in range(r.randrange(150))) for _ in range(150)]
    texts += ["mit license " * 3000, "MIT" * 5, "license", "Mit  LICENSE"] * 2
    rows = [(i % 100 or None, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in edge_rows()]
    rows += [(5, "apache license")] * 40
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, rule int").repartition(4)
    assert got(L.license_scan(docs), *COLS) == want(slow(rows, listed))


def test_license_suppression(spark):
    """Stronger or equal kinds cover weaker ones inside them, not the other way round."""
    def rule(i, kind, label, words):
        return {"rule": i, "kind": kind, "label": label, "base": False, "weight": 0.5, "words": words}
    listed = [rule(0, NAME, "a", "license b c"), rule(1, NOTICE, "b", "license b"), rule(2, HINT, "c", "x license b c y"), rule(3, TAG, "d", "c y license"),
              rule(4, NAME, "e", "license b c"), rule(5, NAME, "f", "b c license z")]
    rows = [(1, "x license b c y license"), (2, "license b c license z"), (3, "license b license b c"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.license_scan(docs, listed=listed), *COLS) == want(slow(rows, listed))
    labels = {r["doc_id"]: r["labels"] for r in L.license_scan(docs, listed=listed).collect()}
    assert labels[1] == "a,b,c,d" and labels[2] == "a,b,f"


def test_license_edges(spark):
    assert got(L.license_scan(edge_docs(spark)), *COLS) == want(slow([(r[0], r[1]) for r in edge_rows()], rules()))
    assert L.license_scan(no_docs(spark)).count() == 0


def test_license_rules():
    listed = rules()
    assert len(listed) > 300 and len({r["words"] for r in listed}) == len(listed) and sum(r["base"] for r in listed) == 3
    for r in listed:
        assert anchor(r["words"]) and re.compile(compiled(r["words"]))
        assert all(w in r["words"].split(" ") for w in required(r["words"]))


def test_license_plan_is_native(spark, monkeypatch):
    monkeypatch.setattr(L, "stored", lambda df, name: df)  # the whole plan in one
    plan = L.op11_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))
