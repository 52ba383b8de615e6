"""Dedupe, global index / ntile without a single-task window, member flags, html text, dates."""

import duckdb
from pyspark.sql import functions as F

from lexiframe.operators import corpus as CO
from lexiframe.operators import filings as FI
from lexiframe.operators import panel as P


def test_dedupe_first_ties_and_idempotent(spark):
    df = spark.createDataFrame([(3, "t", "A"), (1, "t", "A"), (2, "t", "B"), (4, "u", "A")], "id int, text string, e string")
    once = CO.dedupe_by(df, ["text", "e"], ["id"])
    assert sorted(r.id for r in once.collect()) == [1, 2, 4]
    twice = CO.dedupe_by(once, ["text", "e"], ["id"])
    assert sorted(r.id for r in twice.collect()) == [1, 2, 4]


def test_row_index_and_ntile_match_sql(spark):
    n = 1037
    df = spark.range(n).withColumn("k", (F.col("id") * 7919) % n)
    idx = CO.row_index(df, ["k"], with_total=True, num_parts=7)
    got = {r.k: (r.row_idx, r.t) for r in idx.select("k", "row_idx", CO.ntile_of("row_idx", "_total", 100).alias("t")).collect()}
    con = duckdb.connect()
    exp = con.execute(f"SELECT k, row_number() OVER (ORDER BY k) - 1, ntile(100) OVER (ORDER BY k) FROM "
                      f"(SELECT (i * 7919) % {n} AS k FROM range({n}) t(i))").fetchall()
    assert got == {k: (a, b) for k, a, b in exp}


def test_row_index_per_group(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, g int")
    out = CO.row_index(df, ["id"], partition_cols=["g"], num_parts=4).collect()
    for g in range(3):
        ids = sorted((r.id, r.row_idx) for r in out if r.g == g)
        assert [x[1] for x in ids] == list(range(len(ids)))


def test_member_flags(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, p string")
    out = CO.member_flags(df, "p", {"l1": ["a"], "l2": ["a", "b"]}).orderBy("id").collect()
    assert [(r.l1, r.l2) for r in out] == [(1, 1), (0, 1), (0, 0)]


def test_html_text(spark):
    html = ("<html><head><style>p{x}</style><script>var t=\"</p>\";</script></head><body><!-- c -->"
            "<table><tr><td>cell</td></tr></table><p>A &amp; B &lt;x&gt;</p><p>C</p></body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(FI.html_text(F.col("h")).alias("t")).first().t == "A & B <x> C"


def test_month_spine_day_31(spark):
    ten = spark.createDataFrame([("E", "2000-01-31", "2000-04-02")], "entity string, entry_date string, end_date string").select(
        "entity", F.to_date("entry_date").alias("entry_date"), F.to_date("end_date").alias("end_date"))
    months = [str(r.month) for r in P.month_spine(ten).orderBy("month").collect()]
    assert months == ["2000-01-01", "2000-02-01", "2000-03-01", "2000-04-01"]


def test_date_extract_invalid_is_null(spark):
    df = spark.createDataFrame([("Date: 01.02.2004\nx",), ("Date: 31.02.2004\nx",), ("no marker 01.02.2004",)], "t string")
    raw = F.regexp_extract("t", r"Date: ([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1)
    got = [r.d for r in df.select(F.try_to_date(raw, "dd.MM.yyyy").alias("d")).collect()]
    assert str(got[0]) == "2004-02-01" and got[1] is None and got[2] is None


def test_asof_after_and_before(spark):
    q = spark.createDataFrame([(1, "2000-01-05"), (1, "2000-01-10"), (2, "2000-01-01")], "ticker int, d string").select(
        "ticker", F.to_date("d").alias("target"))
    p = spark.createDataFrame([(1, "2000-01-05", 10.0), (1, "2000-01-08", 11.0), (2, "2000-02-01", 5.0)],
                              "ticker int, d string, close double").select("ticker", F.to_date("d").alias("date"), "close")
    a = {(r.ticker, str(r.target)): r.close_after for r in FI.asof(q, p, "ticker", "target", "date", "close", "after").collect()}
    b = {(r.ticker, str(r.target)): r.close_before for r in FI.asof(q, p, "ticker", "target", "date", "close", "before").collect()}
    assert a == {(1, "2000-01-05"): 10.0, (1, "2000-01-10"): None, (2, "2000-01-01"): 5.0}
    assert b == {(1, "2000-01-05"): None, (1, "2000-01-10"): 11.0, (2, "2000-01-01"): None}


def test_stream_panel_equals_batch(spark, tmp_path):
    import shutil
    from lexiframe.streaming import panel_stream as PS
    from lexiframe.plans import views as V
    sf = "/root/testdata/sf0.001"
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{sf}/documents.parquet", src / "part-0.parquet")
    q = PS.start_panel_counts(spark, str(src), sf, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {(r.year, r.quarter, r.entity): r.total_articles for r in PS.read_panel(spark, str(tmp_path / "out")).collect()}
    a = V.articles(spark, sf)
    exp = {(r.year, r.quarter, r.entity): r.n for r in a.groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter"), "entity").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp
