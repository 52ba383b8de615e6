"""Lexicon joins C6-C8 and lexicon-driven article features I10-I14."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import lexicon as LX

ART = S.ART
LEX_VALUES = S.values(C.LEXICON, ["category", "term"], "lx")
N_MAX = LX.max_term_words(C.LEXICON)

TOK = f"SELECT doc_id, {S.word_tokens_sql('text')} AS t FROM documents"
GRAMS = f"""
tok AS ({TOK}),
grams AS (SELECT doc_id, unnest(t) AS term FROM tok
          UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok)"""


@register("lexicon_word_join", sql=S.with_(GRAMS) + f"""
SELECT g.doc_id, lx.category, count(DISTINCT g.term) AS n_terms FROM grams g JOIN {LEX_VALUES} ON lx.term = g.term
GROUP BY ALL""")
def lexicon_word_join(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return LX.word_join(docs, "doc_id", "text", V.lexicon(spark), N_MAX)


@register("lexicon_substring_join", sql=f"""
SELECT d.doc_id, lx.category, count(DISTINCT lx.term) AS n_terms
FROM documents d JOIN {LEX_VALUES} ON contains(lower(d.text), lx.term) GROUP BY ALL""")
def lexicon_substring_join(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return LX.substring_join(docs, "doc_id", "text", V.lexicon(spark))


@register("term_search", sql="""
WITH terms AS (SELECT DISTINCT 'w' || length(w) AS category, w AS term
  FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE length(w) > 3)
SELECT doc_id, category, count(*) AS n_terms FROM documents JOIN terms ON contains(lower(text), term) GROUP BY ALL""")
def term_search(spark, d):
    """The lexicon: every longer word of the benchmark items, its category the length."""
    words = V.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where("length(term) > 3")
    terms = words.distinct().select(F.concat(F.lit("w"), F.length("term")).alias("category"), "term")
    return LX.term_search(V.table(spark, d, "documents"), "doc_id", "text", terms)


_CAPS = [c for _, c in C.REGION_CAPITALS]


@register("lexicon_exclude_own", sql=S.with_(ART) + f""",
caps AS (SELECT * FROM {S.values(C.REGION_CAPITALS, ['region', 'capital_term'], 'rc')})
SELECT a.article_id,
       CASE WHEN a.entity IN ({', '.join(S.q(e) for e in C.AMBIGUOUS_ENTITIES)}) THEN 0
            ELSE len(list_filter(list_distinct({S.word_tokens_sql('a.text')}),
                 lambda t: list_contains({S.str_list(_CAPS)}, t) AND t <> coalesce(own.capital_term, '')
                           AND NOT list_contains({S.str_list(C.AMBIGUOUS_TERMS)}, t))) END AS n_other_capitals
FROM art a LEFT JOIN caps own ON own.region = a.region""")
def lexicon_exclude_own(spark, d):
    a = V.articles(spark, d).select("article_id", "text", "entity", "region")
    a = a.join(V.region_capitals(spark), "region", "left")
    allowed = F.filter(F.array(*[F.lit(c) for c in _CAPS]),
                       lambda c: (c != F.coalesce(F.col("capital_term"), F.lit("")))
                       & ~F.array_contains(F.array(*[F.lit(t) for t in C.AMBIGUOUS_TERMS]), c))
    n = F.size(F.array_intersect(X.word_tokens(F.col("text")), allowed))
    return a.select("article_id", F.when(F.col("entity").isin(*C.AMBIGUOUS_ENTITIES), F.lit(0)).otherwise(n)
                    .alias("n_other_capitals"))


ENTITY_MENTION_SQL = f"len(list_filter({S.str_list(C.ENTITY_STEMS)}, lambda s: s <> a.stem AND contains(lower(a.text), s)))"


def entity_mentions(lowered, stem):
    """Stems other than the row's own in its text; callers pass the text lower-cased, once a row."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in C.ENTITY_STEMS]),
                           lambda s: (s != stem) & lowered.contains(s)))


@register("entity_mention_features", sql=S.with_(ART) + f"""
SELECT article_id, n_entities, round(CAST(n_entities AS DOUBLE) / nullif(words, 0), 6) AS entities_share,
       CAST(n_entities > 0 AS INTEGER) AS entities_flag
FROM (SELECT a.article_id, {ENTITY_MENTION_SQL} AS n_entities, len({S.word_tokens_sql('a.text')}) AS words FROM art a)""")
def entity_mention_features(spark, d):
    a = V.articles(spark, d).withColumn("_low", F.lower("text"))
    n = entity_mentions(F.col("_low"), F.col("stem"))
    out = a.select("article_id", n.alias("n_entities"), F.size(X.word_tokens(F.col("text"))).alias("words"))
    return out.select("article_id", "n_entities", X.r6(X.safe_div(F.col("n_entities"), F.col("words"))).alias("entities_share"),
                      (F.col("n_entities") > 0).cast("int").alias("entities_flag"))
