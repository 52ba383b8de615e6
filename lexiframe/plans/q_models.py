"""Model jobs K1-K19 (exact tables with SQL; fitted models rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import models as M
from ..operators import ml as ML
from ..sources import tables as TB

MIN_DF, MAX_DF = ML.MIN_DF, ML.MAX_DF

TOK_SQL = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)"
GRAMS_SQL = f"""
tk AS (SELECT doc_id, {TOK_SQL} AS t FROM documents),
gr AS (SELECT doc_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tk),
n AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(g) AS term FROM gr) GROUP BY term),
vocab AS (SELECT term, df FROM dfq, n WHERE df >= {MIN_DF} * n.n AND df <= {MAX_DF} * n.n)"""


def _term_counts(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    n_docs = docs.count()
    toks = M.by_document(docs, "doc_id", n_docs).select("doc_id", M.doc_tokens("text").alias("_t"))
    return M.term_counts(toks.select("doc_id", M.uni_bi_grams(F.col("_t")).alias("g")), "doc_id", "g"), n_docs


def _vocab(spark, d):
    tf, n_docs = _term_counts(spark, d)
    return tf, M.vocabulary(M.document_frequency_from_tf(tf), n_docs, MIN_DF, MAX_DF), n_docs


@register("bag_of_ngrams", sql=S.with_(GRAMS_SQL) + "SELECT term, df FROM vocab")
def bag_of_ngrams(spark, d):
    return _vocab(spark, d)[1]


@register("tfidf", sql=S.with_(GRAMS_SQL) + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM gr) GROUP BY ALL),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w FROM tf JOIN vocab v USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf(spark, d):
    tf, vocab, n_docs = _vocab(spark, d)
    return M.tfidf_long(tf, "doc_id", F.broadcast(TB.stored(vocab, "vocabulary")), n_docs)


LABELED_SQL = S.with_(S.ART) + """,
lab AS (SELECT article_id, label FROM art WHERE label IS NOT NULL)"""


def labeled(spark, d):
    return V.labelled_articles(spark, d).filter(F.col("label").isNotNull()).select("article_id", "label", "text")


@register("balanced_weights", sql=LABELED_SQL + """
SELECT article_id, label, CAST((SELECT count(*) FROM lab) AS DOUBLE) / ((SELECT count(DISTINCT label) FROM lab) * count(*) OVER (PARTITION BY label)) AS weight
FROM lab""")
def balanced_weights(spark, d):
    return M.balanced_weights(labeled(spark, d).drop("text"), "label")


@register("split_stratified", sql=LABELED_SQL + """
SELECT article_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY article_id) - 1
       < round(count(*) OVER (PARTITION BY label) * 0.1) AS INTEGER) AS is_test FROM lab""")
def split_stratified(spark, d):
    return M.stratified_split(labeled(spark, d).drop("text"), "label", "article_id", 0.1, seed=None)


SCORES_SQL = S.with_(S.ART, S.PASSAGE_ROWS) + """,
sc AS (SELECT a.article_id, a.label, CAST(p.sentlength AS DOUBLE) / (p.sentlength + 1) AS probability
       FROM art a JOIN passage p USING (article_id))"""


def scores(spark, d):
    from ..operators import articles as AR
    a = AR.entity_passage(V.labelled_articles(spark, d))
    return a.select("article_id", "label", (F.col("sentlength").cast("double") / (F.col("sentlength") + 1)).alias("probability"))


@register("threshold", sql=SCORES_SQL + """
SELECT article_id, CAST(probability >= 0.5 AS INTEGER) AS predicted,
       round(CASE WHEN probability >= 0.5 THEN probability ELSE 0 END, 6) AS probability FROM sc""")
def threshold(spark, d):
    s = scores(spark, d)
    return ML.threshold(s, "probability", 0.5)


@register("rmse_mse", sql=SCORES_SQL + """
SELECT round(avg(pow(label - probability, 2)), 6) AS mse, round(sqrt(avg(pow(label - probability, 2))), 6) AS rmse, count(*) AS n
FROM sc WHERE label IS NOT NULL""")
def rmse_mse(spark, d):
    return M.rmse_mse(scores(spark, d).filter(F.col("label").isNotNull()), "label", "probability")


def _model_sql() -> str:
    """``long``: the sparse long table of terms and numbers of the labelled articles, as (article_id, label, kind, name,
    value); ``scored``: the F score of each column; ``chosen``: the best 1,000."""
    from . import q_features as QF
    names = ", ".join(S.q(n) for n in QF.feature_names())
    values = ", ".join(f"CAST(coalesce({q}, 0) AS DOUBLE)" for _, _, q in QF.all_features())
    return S.with_(S.ART, S.PASSAGE_ROWS, QF.CHAIN_SQL) + f""",
lab AS (SELECT f.*, a.label FROM feat f JOIN art a USING (article_id) WHERE a.label IS NOT NULL),
ltok AS (SELECT article_id, label, regexp_extract_all(lower(lemma_text), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1) AS t FROM lab),
lgram AS (SELECT article_id, label, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM ltok),
ltf AS (SELECT article_id, label, term, count(*) AS tf FROM lgram GROUP BY ALL),
ln_ AS (SELECT count(*) AS n FROM lab),
lvoc AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM ltf, ln_ GROUP BY term
         HAVING count(*) >= {MIN_DF} * any_value(n) AND count(*) <= {MAX_DF} * any_value(n)),
lw AS (SELECT article_id, label, term, tf * idf AS w FROM ltf JOIN lvoc USING (term)),
long AS (
  SELECT article_id, label, 'term' AS kind, term AS name, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS value FROM lw
  UNION ALL SELECT * FROM (SELECT article_id, label, 'feature' AS kind, unnest([{names}]) AS name, unnest([{values}]) AS value FROM lab) WHERE value <> 0),
nc AS (SELECT label, count(*) AS nc FROM lab GROUP BY label),
g AS (SELECT kind, name, label, sum(value) AS s, sum(value * value) AS q FROM long GROUP BY ALL),
t AS (SELECT kind, name, sum(s) AS s, sum(q) AS q, sum(s * s / nc) AS b FROM g JOIN nc USING (label) GROUP BY kind, name),
whole AS (SELECT sum(nc) AS n, count(*) AS k FROM nc),
scored AS (SELECT kind, name, round(((b - s * s / n) / (k - 1)) / nullif((q - b) / (n - k), 0), 6) AS f_score FROM t, whole),
chosen AS (SELECT kind, name, f_score, row_number() OVER (ORDER BY f_score DESC, kind, name) - 1 AS rank FROM scored
           WHERE f_score IS NOT NULL QUALIFY rank < 1000)
"""


@register("select_k_anova", sql=_model_sql() + "SELECT rank, kind, name, f_score FROM chosen")
def select_k_anova(spark, d):
    """The 1,000 columns, of all terms and numbers, that the fitted models use."""
    lab = TB.stored(ML.labeled_frame(spark, d), "labelled")
    return ML.select_k(ML.scored_columns(lab)[2], ML.KEYS, 1000).select("rank", "kind", "name", "f_score")


# ---------------- fitted models (rows-only checks: MLlib and the reference library differ in RNG)


@register("assemble", sql=_model_sql() + """
SELECT article_id, kind || ':' || name AS name, round(value, 6) AS value FROM long JOIN chosen USING (kind, name)""")
def assemble(spark, d):
    """The entries of the assembled vectors by the names that the vectors carry."""
    lab = TB.stored(ML.labeled_frame(spark, d), "labelled")
    return ML.named_values(TB.stored(ML.fit_features(lab)[1], "vectors")).withColumn("value", X.r6(F.col("value")))


@register("split_random")
def split_random(spark, d):
    train, test = labeled(spark, d).drop("text").randomSplit([0.8, 0.2], seed=42)
    return train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))


@register("rf_base")
def rf_base(spark, d):
    return ML.fit_and_report(spark, d, ML.rf_base())


@register("rf_variants")
def rf_variants(spark, d):
    return ML.rf_variants_report(spark, d)


@register("boosted_classifier")
def boosted_classifier(spark, d):
    return ML.boosted_report(spark, d)


@register("linear_models")
def linear_models(spark, d):
    return ML.linear_report(spark, d)


@register("stacking")
def stacking(spark, d):
    return ML.stacking_report(spark, d)


@register("grid_tune")
def grid_tune(spark, d):
    return ML.whole_trials(spark, d)


@register("rank_trials")
def rank_trials(spark, d):
    t = ML.whole_trials(spark, d)
    return t.orderBy(F.desc("mean_precision"), "trial").select("trial", "trees", "depth", "least_split", "least_leaf", "bootstrap", *[
        F.round(f"mean_{m}", 3).alias(f"mean_{m}") for m in ("precision", "recall", "accuracy", "f1")])


@register("grid_refit")
def grid_refit(spark, d):
    return ML.refit_report(spark, d)


@register("cross_validate")
def cross_validate(spark, d):
    return ML.cross_validate(spark, d, k=10)


@register("score_corpus")
def score_corpus(spark, d):
    return ML.score_corpus(spark, d)


@register("rf_regressor")
def rf_regressor(spark, d):
    return ML.regress(spark, d, "rf")


@register("boosted_regressor")
def boosted_regressor(spark, d):
    return ML.regress(spark, d, "gbt")
