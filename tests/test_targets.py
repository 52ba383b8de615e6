"""Price targets are looked up in a list of prices for each ticker: as found by hand, and neither horizons nor prices are rows of an exchange."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lexiframe.operators import filings as FI
from lexiframe.plans import q_filings as QF


def month(d, h):
    y, m = divmod(d.year * 12 + d.month - 1 + h, 12)
    for day in range(d.day, 0, -1):
        try:
            return dt.date(y, m + 1, day)
        except ValueError:
            pass


def test_targets_by_hand(spark, tmp_path):
    r = np.random.default_rng(2)
    day = dt.datetime(2019, 1, 31)
    lines = [(int(r.integers(0, 60)), None if r.random() < 0.05 else int(r.integers(1, 5)), day + dt.timedelta(days=int(r.integers(0, 900))), 4.0, float(r.integers(1, 99))) for _ in range(300)]
    lines += lines[:20]
    orders = [(k, day + dt.timedelta(days=int(r.integers(0, 700)))) for k in [*range(60), *range(10)]]  # some come twice, with other dates
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    out = QF.performance_targets(spark, str(tmp_path))
    got = {(q.report, q.ticker): tuple(q)[2:] for q in out.collect()}
    prices = {}
    for _, t, d, n, v in lines:
        prices[t, d.date()] = max(v / n, prices.get((t, d.date()), 0))

    def close(t, at):
        days = sorted(d for k, d in prices if k == t and d >= at and (t is not None or d.year == at.year))
        return prices[t, days[0]] if days else None

    want = {}
    for k, t in {(k, t) for k, t, *_ in lines}:
        found = [[c for o, d in orders if o == k and (c := close(t, month(d.date(), h))) is not None] for h in QF.HORIZONS]
        c = [max(x) if x else None for x in found]
        want[k, t] = tuple(None if x is None or c[0] is None else round(x / c[0] - 1, 6) for x in c[1:])
    assert got.keys() == want.keys() and sum(v[0] is not None for v in want.values()) > 100
    for k, w in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-6) for a, b in zip(got[k], w))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan and "explode" not in plan.lower() and "Union" not in plan


def test_undated_prices(spark):
    p = FI.value_lists(spark.createDataFrame([(1, dt.date(2020, 1, 2), 2.0), (1, None, 7.0), (1, dt.date(2020, 1, 1), None), (2, None, 5.0), (3, dt.date(2020, 1, 1), None)],
                                             "k int, d date, v double"), "d", "v")
    at = [FI.value_from(F.lit(x).cast("date"), F.lit(False)).alias(n) for n, x in (("a", "2020-01-01"), ("b", "2020-01-03"), ("c", None))]
    assert sorted(map(tuple, p.select("k", *at).collect())) == [(1, 2.0, None, 7.0), (2, None, None, 5.0)]
