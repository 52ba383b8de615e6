"""Article text jobs I1-I9 and the passage-derived corpus rows (B11, E6, G2, I3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import articles as AR
from ..operators import lexicon as LX
from ..sources import tables as TB

ART, PR = S.ART, S.PASSAGE_ROWS


def passages(spark, d):
    return AR.entity_passage(V.articles(spark, d))


@register("sentences", sql=S.with_(ART, PR.split("flag AS")[0].rstrip().rstrip(",")) + """
SELECT article_id, pos, sentence FROM sent""")
def sentences(spark, d):
    a = V.articles(spark, d).select("article_id", X.sentences(F.col("text")).alias("s"))
    return a.select("article_id", F.posexplode("s").alias("pos", "sentence")).withColumn("pos", F.col("pos") + 1)


@register("entity_passage", sql=S.with_(ART, PR) + "SELECT article_id, passage, sentlength FROM passage")
def entity_passage(spark, d):
    return passages(spark, d).select("article_id", "passage", "sentlength")


@register("unmatched_review", sql=S.with_(ART, PR) + """
SELECT a.article_id, a.entity FROM art a JOIN passage p USING (article_id) WHERE p.sentlength = 0""")
def unmatched_review(spark, d):
    return passages(spark, d).filter(F.size("passage_sents") == 0).select("article_id", "entity")


@register("keep_nonempty", sql=S.with_(ART, PR) + "SELECT article_id, passage FROM passage WHERE passage <> ''")
def keep_nonempty(spark, d):
    return passages(spark, d).filter(F.col("passage") != "").select("article_id", "passage")


@register("neighbour_sentences", sql=S.with_(ART, PR) + """
SELECT w.article_id, w.pos, s.sentence FROM win w JOIN sent s USING (article_id, pos) WHERE w.keep""")
def neighbour_sentences(spark, d):
    return AR.neighbour_sentences(V.articles(spark, d).select("article_id", "text", "stem")).select(
        "article_id", "pos", "sentence")


@register("distinct_sentences", sql=S.with_(ART) + f""",
s AS (SELECT article_id, {S.sentences_sql('text')} AS ss FROM art)
SELECT article_id, len(ss) AS n_sentences, len(list_distinct(ss)) AS n_distinct FROM s""")
def distinct_sentences(spark, d):
    a = V.articles(spark, d).select("article_id", X.sentences(F.col("text")).alias("ss"))
    return a.select("article_id", F.size("ss").alias("n_sentences"), F.size(F.array_distinct("ss")).alias("n_distinct"))


def _clean_sql(col: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), '[^\\p{{L}}. \\t\\r\\n]+', ' ', 'g'), "
            f"'{S.SP}+'), lambda w: w <> '' AND length(w) > 1 AND NOT list_contains({S.str_list(C.STOPWORDS)}, w))")


@register("clean_tokens", sql=f"SELECT doc_id, array_to_string({_clean_sql('text')}, ' ') AS clean_text FROM documents")
def clean_tokens(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(AR.clean_tokens(F.col("text")), " ").alias("clean_text"))


_LEMMA_CASE = "CASE t " + " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in C.LEMMAS) + " ELSE t END"


@register("lemma_map", sql=f"""
SELECT doc_id, array_to_string(list_transform({_clean_sql('text')}, lambda t: {_LEMMA_CASE}), ' ') AS lemma_text
FROM documents""")
def lemma_map(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(AR.lemmatize(AR.clean_tokens(F.col("text"))), " ").alias("lemma_text"))


def suffix_lemmas(forms):
    """Lemma table of a vocabulary: the fixed lemmas, else a form in -s is a form of the word without it, if there is one."""
    fixed = V.fixed(forms.sparkSession, C.LEMMAS, "form string, lemma string")
    cut = forms.where(F.col("form").endswith("s") & (F.length("form") > 3)).select(
        "form", F.expr("left(form, length(form) - 1)").alias("lemma"))
    cut = cut.join(forms.select(F.col("form").alias("lemma")), "lemma", "left_semi").join(fixed.select("form"), "form", "left_anti")
    return fixed.unionByName(cut.select("form", "lemma"))


@register("lemma_table", sql=f"""
WITH t AS (SELECT doc_id, {_clean_sql('text')} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS form, unnest(range(len(w))) AS pos FROM t),
voc AS (SELECT DISTINCT form FROM tok), fixed AS (SELECT * FROM {S.values(C.LEMMAS, ['form', 'lemma'], 'lm')}),
lem AS (SELECT form, lemma FROM fixed UNION ALL
        SELECT form, left(form, length(form) - 1) FROM voc WHERE suffix(form, 's') AND length(form) > 3
          AND left(form, length(form) - 1) IN (FROM voc) AND form NOT IN (SELECT form FROM fixed))
SELECT t.doc_id, coalesce(any_value(g.lemma_text), '') AS lemma_text FROM t LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(lemma, tok.form), ' ' ORDER BY pos) AS lemma_text
  FROM tok LEFT JOIN lem ON lem.form = tok.form GROUP BY doc_id) g ON g.doc_id = t.doc_id GROUP BY t.doc_id""")
def lemma_table(spark, d):
    """Texts lemmatised by a table as large as their vocabulary."""
    docs = V.table(spark, d, "documents").select("doc_id", AR.clean_tokens(F.col("text")).alias("tokens"))
    docs = TB.stored(docs, "clean-tokens")  # read for the vocabulary, the frequent forms and the texts
    forms = docs.select(F.explode("tokens").alias("form")).distinct()
    out = LX.lemmatize_join(docs, "doc_id", "tokens", suffix_lemmas(forms))
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemma_text"))


_RAW_SQL = """len(string_split(text, ' ')) AS words, length(text) AS chars, len(string_split(text, '.')) AS sents,
       round(CAST(length(text) AS DOUBLE) / nullif(len(string_split(text, ' ')), 0), 6) AS avg_word,
       round(CAST(len(string_split(text, ' ')) AS DOUBLE) / nullif(len(string_split(text, '.')), 0), 6) AS avg_sent"""


@register("length_raw", sql=f"SELECT doc_id, {_RAW_SQL} FROM documents")
def length_raw(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in AR.length_raw(F.col("text")).items()])
