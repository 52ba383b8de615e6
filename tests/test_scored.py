"""Scored rows: the model of rule flags against counts by hand, flags and masked values by their definitions."""

import datetime as dt
import math
from itertools import product

from pyspark.sql import functions as F

from lexiframe.operators import panel as P
from lexiframe.operators import scored as SC

TRAIN = [(1, 1, 0), (1, 1, 1), (1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 0, None), (None, 1, 1)]
DAY = dt.date(1997, 5, 3)


def test_flag_bayes_counts_by_hand(spark):
    model = SC.flag_bayes(spark.createDataFrame(TRAIN, "label int, a int, b int"), ["a", "b"])
    known = [r for r in TRAIN if r[0] is not None]
    n = [sum(r[0] == c for r in known) for c in (0, 1)]
    rows = spark.createDataFrame(list(product((0, 1), (0, 1))), "a int, b int")
    for r in rows.withColumn("p", SC.bayes_probability(model)).collect():
        odds = (n[1] + 1) / (n[0] + 1)
        for i, x in ((1, r.a), (2, r.b)):
            share = []
            for c in (0, 1):
                ones = sum(t[0] == c and t[i] == 1 for t in known)
                share.append(((ones if x else n[c] - ones) + 1) / (n[c] + 2))
            odds *= share[1] / share[0]
        assert math.isclose(r.p, odds / (1 + odds), rel_tol=1e-12)


def test_flag_bayes_without_labels(spark):
    rows = spark.createDataFrame([(None, 1), (None, None)], "label int, a int")
    model = SC.flag_bayes(rows, ["a"])
    assert model == (0.0, {"a": (0.0, 0.0)})
    assert [r.p for r in rows.withColumn("p", SC.bayes_probability(model)).collect()] == [0.5, 0.5]
    assert SC.flag_bayes(rows.limit(0), ["a"]) == model


def test_scored_row_by_definition(spark):
    cases = [(i, *x) for i, x in enumerate(product((0, 1), (0, 1), (0, 1), (0.2, 0.5, 0.9)))]
    frame = spark.createDataFrame([(*c, 0.3, 0.1, DAY, "x" if c[0] % 2 else None) for c in cases],
                                  "id int, interview int, other_entities int, with_president int, p double, positive double, "
                                  "negative double, date date, publisher string")
    got = {r.id: r for r in SC.scored_row(frame, F.col("p"), {"in_x": ["x"]}).collect()}
    assert len(got) == len(cases)
    for i, talk, others, boss, p in cases:
        r, yes = got[i], p >= 0.5
        assert (r.predicted, r.probability, r.year, r.month, r.in_x) == (int(yes), p if yes else 0.0, 1997, 5, i % 2)
        assert [r[n] for n, _ in SC.FLAGS] == [int(x) for x in (
            not others, yes and boss, yes and not others, yes and talk, talk and not others, yes and talk and not others)]
        assert [r[n] for n, _, _ in SC.MASKED] == [0.3 * yes, 0.1 * yes, 0.3 * (yes and boss), 0.1 * (yes and boss)]


def test_panel_sums_fractions_and_counts(spark):
    rows = spark.createDataFrame([("e", DAY, 1, 0.25), ("e", DAY, 2, 0.5), ("e", DAY, 3, None)], "entity string, date date, n int, x double")
    (r,) = P.panel(rows, "quarter", ["n", "x"]).collect()
    assert tuple(r) == (1997, 2, "e", 3, 6, 0.75)


def test_panels_and_frame_share_their_rules(spark):
    from lexiframe.plans import q_features as QF
    from lexiframe.plans import q_panel as QP
    sf = "/root/testdata/sf0.001"
    names = ["head_of_state", "council", "party", "speech", "rating"]
    frame = QF.chain(spark, sf).select("article_id", *[F.expr(c).alias(n) for n, c, _ in QF.rules(names)])
    scored = QP.scored_articles(spark, sf).select("article_id", *names)
    assert scored.count() > 0 and scored.exceptAll(frame).count() == 0
