"""Faults that small data hid: lost rows, cut ids, quadratic frames, nested markup, literal stems."""

import time

import pytest
from pyspark.sql import functions as F

from lexiframe.functions import text as X
from lexiframe.operators import corpus as CO
from lexiframe.operators import filings as FI
from lexiframe.operators import keystrokes as K
from lexiframe.operators import models as M
from lexiframe.plans import q_scalars as QS


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_row_index_keeps_every_row(spark, groups):
    n = 2_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = CO.row_index(df, ["k"], partition_cols=groups, with_total=True)
    r = out.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d"), F.min("row_idx").alias("lo"),
                                 F.max("row_idx").alias("hi"), F.max("_total").alias("t")).collect()
    assert sum(x["n"] for x in r) == n
    assert all(x["n"] == x["d"] == x["t"] and x["lo"] == 0 and x["hi"] == x["n"] - 1 for x in r)
    if not groups:
        assert out.filter("row_idx <> k").count() == 0


def test_long_ids_are_not_cut(spark):
    df = spark.createDataFrame([(5,), (1234567890123,)], "k long").select(X.pad_id("k").alias("p"))
    assert sorted(r["p"] for r in df.collect()) == ["0000000005", "1234567890123"]


def test_asof_hot_key(spark):
    prices = spark.range(40_000).select(F.lit(1).alias("t"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("d"), F.col("id").cast("double").alias("close"))
    prices = prices.filter("year(d) % 3 <> 1").cache()
    queries = spark.range(0, 40_000, 4).select(F.col("id").alias("q"), F.lit(1).alias("t"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("at"))
    FI.asof(queries, prices, "t", "at", "d", "close").count()
    t0 = time.time()
    got = {r["q"]: (r["close_after"], r["close_before"]) for r in FI.asof(queries, prices, "t", "at", "d", "close").collect()}
    assert time.time() - t0 < 6
    days = sorted(int(r["close"]) for r in prices.collect())
    import bisect
    for q in range(0, 40_000, 400):
        i = bisect.bisect_left(days, q)
        assert got[q] == (days[i] if i < len(days) else None, days[i - 1] if i else None)


def test_html_nested_tables_and_numbers(spark):
    rows = [(1, "a<table><tr><td>x<table><tr><td>y</table>LEFT</table>b"), (2, "it&#8217;s &#x41;&#xD800; &#9;z &amp;#65; &#; &#99999999;"),
            (3, "no tables"), (4, "<TABLE a=1>t</TABLE><table>u</table>v"), (5, None), (6, "&#128512;!")]
    df = spark.createDataFrame(rows, "i int, h string").select("i", FI.html_text(F.col("h")).alias("t"))
    got = {r["i"]: r["t"] for r in df.collect()}
    assert got == {1: "a b", 2: "it’s A&#xD800; z &#65; &#; &#99999999;", 3: "no tables", 4: "v", 5: None, 6: "\U0001F600!"}


def test_stem_is_a_literal(spark):
    df = spark.createDataFrame([("see foo (x) now", "foo (x"), ("a.b here", "a.b"), ("axb here", "a.b"), ("q\\Er", "q\\Er")], "t string, s string")
    hit = [r["h"] for r in df.select(F.regexp_like("t", X.stem_hit_rx(F.col("s"))).alias("h")).collect()]
    assert hit == [True, True, False, True]


def test_writer_without_edits_has_a_row(spark):
    log = spark.createDataFrame([(1, 1, 0, 5, "Nonproduction", "NoChange", 0), (2, 1, 0, 5, "Remove/Cut", "abc", 3)],
                                "id int, event_id int, down_time long, up_time long, activity string, text_change string, cursor_position int")
    got = {r["id"]: r for r in K.edit_features(log).collect()}
    assert set(got) == {1, 2} and got[1]["backcount"] == 0 and got[2]["avcorrection"] == 3.0
    agg = {r["id"]: r for r in K.conditional_aggs(log, [("n", None, "count"), ("cut", "Remove/Cut", "length")]).collect()}
    assert agg[1]["n"] == 1 and agg[1]["cut"] == 0 and agg[2]["cut"] == 3


def test_replay_of_real_edits(spark):
    rows = [(1, "Input", "hello world", 11), (2, "Input", "big ", 10), (3, "Remove/Cut", "hello ", 0), (4, "Replace", "world => old moon", 12),
            (5, "Move From [0, 4] To [4, 8]", "", 0), (6, "Paste", "!!", 14)]
    log = spark.createDataFrame([(7, *r) for r in rows], "id int, event_id int, activity string, text_change string, cursor_position int")
    s = "hello world"
    s = s[:6] + "big " + s[6:]
    s = s[6:]
    s = s[:4] + "old moon" + s[9:]
    rest = s[4:]
    s = rest[:4] + s[:4] + rest[4:]
    s = s[:12] + "!!" + s[12:]
    assert K.replay(log).first()["final_text"] == s


def test_term_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "id int, g array<string>")
    assert sorted(tuple(r) for r in M.term_counts(df, "id", "g").collect()) == [(1, "a", 1), (1, "b", 2), (3, "c", 1)]


def test_mojibake(spark):
    texts = ["Привет, мир", "plain", "déjà vu", "дом Ж", "", None, "mixed 漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", QS.repair_mojibake(QS.damage_mojibake(F.col("t"))).alias("r"), QS.repair_mojibake(F.col("t")).alias("same"))
    for r in df.collect():
        assert r["r"] == r["t"] and r["same"] == r["t"]


def test_stacking_scores_without_probability(spark):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import Vectors

    from lexiframe.operators import ml as ML
    df = spark.createDataFrame([(i, float(i % 2), Vectors.dense([i % 2 + 0.1 * (i % 5), 1.0])) for i in range(40)], ["article_id", "label", "features"])
    out = ML._score(LinearSVC(maxIter=5).fit(df).transform(df)).collect()
    assert len(out) == 40 and all(isinstance(r["s"], float) for r in out)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_stay_with_their_document(spark):
    """Texts are exchanged, the long table of terms is not; and n-grams are not made where texts are read. Rows that
    repeat an id, or have none, count as one document."""
    docs = spark.createDataFrame([(1, "red fish"), (1, "red fish"), (2, "blue fish"), (None, "red"), (None, "red"), (3, None), (4, "")], "doc_id long, text string")
    toks = M.by_document(docs, "doc_id", 7).select("doc_id", M.doc_tokens("text").alias("_t"))
    tf = M.term_counts(toks.select("doc_id", M.uni_bi_grams(F.col("_t")).alias("g")), "doc_id", "g")
    plan = _plan(tf)
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") and "Filter (size" not in plan
    assert {(r["doc_id"], r["term"], r["tf"]) for r in tf.collect()} == {
        (1, "red", 2), (1, "fish", 2), (1, "red fish", 2), (2, "blue", 1), (2, "fish", 1), (2, "blue fish", 1), (None, "red", 2)}
    assert M.by_document(docs, "doc_id", 4_000_000).rdd.getNumPartitions() == 1000


def test_a_filter_on_passages_splits_sentences_once(spark):
    from lexiframe.operators import articles as AR
    a = spark.createDataFrame([(1, "One is here. The Tree stands! Nothing. More.", "tree"), (2, "No such word. End", "tree"), (3, None, "tree"), (4, "A tree. X", None)],
                              "article_id long, text string, stem string")
    empty = AR.entity_passage(a).filter(F.size("passage_sents") == 0).select("article_id")
    assert _plan(empty).count("split(") == 1
    assert [r["article_id"] for r in empty.orderBy("article_id").collect()] == [2, 4]


def test_asof_sorts_a_bounded_number_of_rows(spark):
    q = spark.createDataFrame([("a", 1)], "k string, n int").select("k", F.lit("2020-01-02").cast("date").alias("t"))
    p = spark.createDataFrame([("a", 3.0)], "k string, close double").select("k", F.lit("2020-01-01").cast("date").alias("d"), "close")
    out = FI.asof(q, p, "k", "t", "d", "close", n_rows=640_000_000)
    assert "hashpartitioning(k" in _plan(out) and ", 640)" in _plan(out)
    assert FI.asof(q, p, "k", "t", "d", "close").first()["close_before"] == 3.0
