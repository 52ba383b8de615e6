"""Scored rows (C5, B16, B17), the panels over them and other aggregations D1-D12. All rules and features are those of
the feature frame (``q_features``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as C
from . import q_features as QF
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import articles as AR
from ..operators import corpus as CO
from ..operators import panel as P
from ..operators import rules as RU
from ..operators import scored as SC
from ..sources import tables as TB

ART, PR = S.ART, S.PASSAGE_ROWS
HOS = RU.rules_by_id(["head_of_state"])[0]
LISTS = {"list_2010": C.PUBLISHERS_2010, "list_2012": C.PUBLISHERS_2012}
RULE_IDS = [r["rule_id"] for r in C.RULES]
POLAR = [f for f in QF.polarity() if f[0] in ("positive", "negative")]
#: what scored rows take from the feature frame; ``head_of_state`` is ``with_president`` there
TAKEN = [QF.interview(), ("other_entities", *QF.entities()[2][1:]), *POLAR, *QF.rules(RULE_IDS), QF.meeting(), *QF.punctuation()[:2]]
MEASURES = ["interview", "other_entities", "with_president", "state_council", "meeting", "positive", "negative", "predicted",
            "probability", *[n for n, _ in SC.FLAGS], *[n for n, _, _ in SC.MASKED], *LISTS, "sentlength", "excl", "comma"]
FRACTIONS = {"positive", "negative", "probability", *[n for n, _, _ in SC.MASKED]}


def scored_articles(spark, d, texts: bool = False, scores: DataFrame | None = None):
    """Scored rows of the deduplicated articles: features and rules, the probability that a model of the rules gives
    (learnt from the labelled ones), flags, masked values and publisher lists; ``texts``: with the raw and clean text.
    ``scores``: probabilities by article_id of another model; articles that it lacks have none and class 0.

    Texts are read once: the features are stored, and copies, the model and the rows are told from that table."""
    known = TB.stored(QF.chain(spark, d, V.labelled_articles(spark, d)).select(
        "article_id", "entity", "date", "publisher", "label", "sentlength", F.sha2("text", 256).alias("digest"),
        *[F.expr(c).alias(n) for n, c, _ in TAKEN],
        *(["text", F.col("lemma_text").alias("clean_text")] if texts else [])), "scored-features")
    keep = CO.dedupe_by(known.select("article_id", "digest", "entity"), ["digest", "entity"], ["article_id"])
    known = known.join(keep.select("article_id"), "article_id", "left_semi").drop("digest")
    rows = known.withColumn("with_president", F.col("head_of_state"))
    if scores is not None:
        rows = rows.join(scores.select("article_id", F.col("probability").alias("given")), "article_id", "left")
        return SC.scored_row(rows, F.coalesce("given", F.lit(0.0)), LISTS).drop("given")
    return SC.scored_row(rows, SC.bayes_probability(SC.flag_bayes(known, RULE_IDS)), LISTS)


def _odds(n1: str, n0: str) -> str:
    return f"ln(({n1} + 1.0) / (n1 + 2.0)) - ln(({n0} + 1.0) / (n0 + 2.0))"


# The counts of the model as rows (rule, value, log odds), and a row's log odds as their sum in the order of the rules.
SCORED_SQL = S.with_(ART, PR, QF.CHAIN_SQL) + f""",
keep AS (SELECT min(article_id) AS article_id FROM art GROUP BY text, entity),
known AS (SELECT article_id, entity, date, publisher, label, sentlength, text, lemma_text AS clean_text,
                 {", ".join(f"{q} AS {n}" for n, _, q in TAKEN)} FROM feat SEMI JOIN keep USING (article_id)),
learnt AS (SELECT * FROM known WHERE label IS NOT NULL),
classes AS (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n0 FROM learnt),
counts AS ({" UNION ALL ".join(f"SELECT {i} AS i, count(*) FILTER (label = 1 AND {r} = 1) AS a, count(*) FILTER (label = 0 AND {r} = 1) AS b FROM learnt"
                               for i, r in enumerate(RULE_IDS))}),
odds AS (SELECT list({_odds('a', 'b')} ORDER BY i) AS yes, list({_odds('n1 - a', 'n0 - b')} ORDER BY i) AS no
         FROM (SELECT i, a, b, n1, n0 FROM counts, classes)),
raw AS (
  SELECT k.*, k.head_of_state AS with_president, 1 / (1 + exp(-(ln((c.n1 + 1) / (c.n0 + 1))
         {"".join(f" + CASE WHEN k.{r} = 1 THEN o.yes[{i + 1}] ELSE o.no[{i + 1}] END" for i, r in enumerate(RULE_IDS))}))) AS p
  FROM known k, classes c, odds o),
marked AS (SELECT * EXCLUDE (p), CAST(p >= 0.5 AS INTEGER) AS predicted, round(CASE WHEN p >= 0.5 THEN p ELSE 0 END, 6) AS probability FROM raw),
scored AS (
  SELECT *, {", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in SC.FLAGS)},
         {", ".join(f"CASE WHEN {e} THEN {v} ELSE 0 END AS {n}" for n, e, v in SC.MASKED)},
         year(date) AS year, month(date) AS month,
         {", ".join(f"CAST(coalesce(publisher IN ({', '.join(S.q(x) for x in names)}), false) AS INTEGER) AS {n}" for n, names in LISTS.items())}
  FROM marked)
"""

SCORED_COLS = ["article_id", "entity", "date", "publisher", *MEASURES, "year", "month"]


@register("assemble_by_id", sql=SCORED_SQL + f"SELECT {', '.join(SCORED_COLS)}, text AS raw_text, clean_text FROM scored")
def assemble_by_id(spark, d):
    """The whole scored row of every article: features, score, flags, masked values, period, lists and both texts."""
    return scored_articles(spark, d, texts=True).select(*SCORED_COLS, F.col("text").alias("raw_text"), "clean_text")


@register("scored_forest")
def scored_forest(spark, d):
    """Scored rows with the probabilities of the saved forest (no SQL: MLlib's random numbers)."""
    from ..operators import ml as ML
    return scored_articles(spark, d, scores=ML.score_corpus(spark, d)).select(*SCORED_COLS)


def _panel_sql(period: str, where: str = "") -> str:
    sums = ", ".join(f"round(sum({m}), 6) AS {m}" if m in FRACTIONS else f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
    return SCORED_SQL + f"""
SELECT year(date) AS year, {period}(date) AS {period}, entity, count(*) AS total_articles, {sums}
FROM scored {where} GROUP BY year(date), {period}(date), entity"""


@register("panel_quarter", sql=_panel_sql("quarter"))
def panel_quarter(spark, d):
    return P.panel(scored_articles(spark, d), "quarter", MEASURES)


@register("panel_month", sql=_panel_sql("month", "WHERE list_2010 = 1"))
def panel_month(spark, d):
    return P.panel(scored_articles(spark, d), "month", MEASURES, source_filter=F.col("list_2010") == 1)


@register("panel_month_all", sql=_panel_sql("month"))
def panel_month_all(spark, d):
    return P.panel(scored_articles(spark, d), "month", MEASURES)


@register("panel_quarter_2010", sql=_panel_sql("quarter", "WHERE list_2010 = 1"))
def panel_quarter_2010(spark, d):
    return P.panel(scored_articles(spark, d), "quarter", MEASURES, source_filter=F.col("list_2010") == 1)


@register("panel_quarter_2012", sql=_panel_sql("quarter", "WHERE list_2012 = 1"))
def panel_quarter_2012(spark, d):
    return P.panel(scored_articles(spark, d), "quarter", MEASURES, source_filter=F.col("list_2012") == 1)


@register("panel_month_2012", sql=_panel_sql("month", "WHERE list_2012 = 1"))
def panel_month_2012(spark, d):
    return P.panel(scored_articles(spark, d), "month", MEASURES, source_filter=F.col("list_2012") == 1)


@register("panel_count", sql=S.with_(ART) + """
SELECT year(date) AS year, quarter(date) AS quarter, entity, count(*) AS total_articles FROM art GROUP BY ALL""")
def panel_count(spark, d):
    return P.panel(V.articles(spark, d), "quarter", [])


@register("panel_sum", sql=S.with_(ART, PR) + """
SELECT year(a.date) AS year, month(a.date) AS month, a.entity, CAST(sum(p.sentlength) AS BIGINT) AS sentlength,
       CAST(sum(length(a.text) - length(replace(a.text, ',', ''))) AS BIGINT) AS comma
FROM art a JOIN passage p USING (article_id) GROUP BY ALL""")
def panel_sum(spark, d):
    a = AR.entity_passage(V.articles(spark, d)).withColumn("comma", X.count_char(F.col("text"), ","))
    return P.panel(a, "month", ["sentlength", "comma"]).drop("total_articles")


@register("audit_totals", sql=SCORED_SQL + """
SELECT count(*) AS n_articles, CAST(sum(with_president) AS BIGINT) AS with_president,
       CAST(sum(state_council) AS BIGINT) AS state_council, CAST(sum(list_2010) AS BIGINT) AS list_2010,
       CAST(sum(list_2012) AS BIGINT) AS list_2012 FROM scored""")
def audit_totals(spark, d):
    s = scored_articles(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_articles"),
                 *[F.sum(c).cast("bigint").alias(c) for c in ["with_president", "state_council", "list_2010", "list_2012"]])


@register("density_histogram", sql="""
WITH st AS (SELECT CAST(min(n_chars) AS DOUBLE) AS mn, CAST(max(n_chars) AS DOUBLE) AS mx, count(n_chars) AS n FROM documents),
b AS (SELECT CAST(least(floor((d.n_chars - st.mn) / ((st.mx - st.mn) / 30)) + 1, 30) AS INTEGER) AS bucket
      FROM documents d, st WHERE d.n_chars IS NOT NULL)
SELECT b.bucket, round(st.mn + (b.bucket - 1) * ((st.mx - st.mn) / 30), 6) AS lo,
       round(st.mn + b.bucket * ((st.mx - st.mn) / 30), 6) AS hi, count(*) AS n,
       round(count(*) / (any_value(st.n) * ((st.mx - st.mn) / 30)), 6) AS density
FROM b, st GROUP BY b.bucket, st.mn, st.mx""")
def density_histogram(spark, d):
    return P.density_histogram(V.table(spark, d, "documents"), "n_chars", 30)


@register("month_hits", sql=S.with_(ART) + """,
ten AS (SELECT n_name AS entity, DATE '1995-01-01' + CAST(n_nationkey * 61 AS INTEGER) AS entry_date,
               DATE '1995-01-01' + CAST(n_nationkey * 61 + 700 + n_nationkey * 37 AS INTEGER) AS end_date FROM nation),
spine AS (SELECT entity, CAST(unnest(generate_series(date_trunc('month', entry_date), date_trunc('month', end_date), INTERVAL 1 MONTH)) AS DATE) AS month FROM ten),
hits AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS c FROM art
         WHERE regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])(?i:the)') GROUP BY ALL)
SELECT s.entity, (year(s.month) - 2000) * 12 + month(s.month) - 1 AS month_idx, strftime(s.month, '%Y-%m') AS month,
       coalesce(h.c, 0) AS hits
FROM spine s LEFT JOIN hits h ON h.entity = s.entity AND h.month = s.month""")
def month_hits(spark, d):
    """Hits per entity and month: articles of the entity containing the search word; absent months 0."""
    a = V.articles(spark, d).filter(F.col("text").rlike(X.prefix_rx("the")))
    ev = a.select("entity", F.trunc("date", "MM").alias("month"))
    out = P.gap_filled_counts(P.tenure_spine(spark, d), ev, ["entity", "month"])
    return out.select("entity", P.month_index(F.col("month")).alias("month_idx"),
                      F.date_format("month", "yyyy-MM").alias("month"), "hits")


# ---- evaluation tables over a fixed prediction: label = annotation, prediction = head-of-state rule

EVAL_SQL = S.with_(ART, PR, QF.CHAIN_SQL) + f""",
ev AS (SELECT article_id, label, {QF.rule(HOS)[2]} AS prediction FROM feat WHERE label IS NOT NULL)
"""


def eval_frame(spark, d):
    a = V.labelled_articles(spark, d).filter(F.col("label").isNotNull())
    return QF.chain(spark, d, a).select("article_id", "label", F.expr(QF.rule(HOS)[1]).alias("prediction"))


@register("confusion_matrix", sql=EVAL_SQL + "SELECT label, prediction, count(*) AS n FROM ev GROUP BY ALL")
def confusion_matrix(spark, d):
    return eval_frame(spark, d).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_report_from(ev):
    from ..operators import models as M
    return M.class_report(ev, "label", "prediction")


@register("class_report", sql=EVAL_SQL + """,
cm AS (SELECT c.cls, sum(CASE WHEN e.prediction = c.cls AND e.label = c.cls THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN e.prediction = c.cls THEN 1 ELSE 0 END) AS pred_n,
              sum(CASE WHEN e.label = c.cls THEN 1 ELSE 0 END) AS support
       FROM ev e, (VALUES (0), (1)) c(cls) GROUP BY c.cls)
SELECT cls, round(CAST(tp AS DOUBLE) / nullif(pred_n, 0), 6) AS precision,
       round(CAST(tp AS DOUBLE) / nullif(support, 0), 6) AS recall,
       round(2.0 * tp / nullif(pred_n + support, 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM cm""")
def class_report(spark, d):
    return class_report_from(eval_frame(spark, d))


@register("score_summary", sql=EVAL_SQL + """,
folds AS (SELECT article_id % 5 AS fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM ev GROUP BY 1)
SELECT round(avg(acc), 6) AS mean_score, round(stddev_pop(acc), 6) AS std_score, count(*) AS n_folds FROM folds""")
def score_summary(spark, d):
    from ..operators import models as M
    ev = eval_frame(spark, d).withColumn("fold", (F.col("article_id") % 5).cast("int"))
    per_fold = ev.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    return M.score_summary(per_fold, "score")


# ---- scored-row flags (B16) and masked values (B17)


@register("derived_flags", sql=SCORED_SQL + f"SELECT article_id, {', '.join(n for n, _ in SC.FLAGS)} FROM scored")
def derived_flags(spark, d):
    return scored_articles(spark, d).select("article_id", *[n for n, _ in SC.FLAGS])


@register("masked_values", sql=SCORED_SQL + f"SELECT article_id, probability, {', '.join(n for n, _, _ in SC.MASKED)} FROM scored")
def masked_values(spark, d):
    return scored_articles(spark, d).select("article_id", "probability", *[n for n, _, _ in SC.MASKED])
