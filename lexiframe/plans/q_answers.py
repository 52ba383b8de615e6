"""Language-model stage: prompts, answers, answer rules (B18-B21, C12, I26, D8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .q_corpus import PRESELECT_SQL, preselected
from .registry import register
from ..functions import text as X

PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""


def answer_pairs(spark, d):
    c = V.table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@register("answer_join", sql=S.with_(PAIRS_SQL) + "SELECT conv_id, turn, prompt, answer FROM pairs")
def answer_join(spark, d):
    return answer_pairs(spark, d)


@register("answer_phrase_any", sql=S.with_(PAIRS_SQL) + "SELECT conv_id, turn, " + ", ".join(
    f"CAST(contains(lower(answer), {S.q(p)}) AS INTEGER) AS {b}" for b, p in C.ANSWER_PHRASES) + " FROM pairs")
def answer_phrase_any(spark, d):
    p = answer_pairs(spark, d)
    return p.select("conv_id", "turn", *[F.lower("answer").contains(ph).cast("int").alias(b) for b, ph in C.ANSWER_PHRASES])


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.get(X.sentences(text), 0), F.lit(""))


FIRST_SQL = f"coalesce({S.sentences_sql('answer')}[1], '')"


def _rule_col(fs: Column, words, nots) -> Column:
    low = F.lower(fs)
    c = F.lit(True)
    for w in words:
        c = c & low.contains(w)
    for w in nots:
        c = c & ~low.contains(w)
    return c.cast("int")


def _rule_sql(fs: str, words, nots) -> str:
    parts = [f"contains(lower({fs}), {S.q(w)})" for w in words] + [f"NOT contains(lower({fs}), {S.q(w)})" for w in nots]
    return "CAST(" + " AND ".join(parts) + " AS INTEGER)"


RULES_SQL = S.with_(PAIRS_SQL, f"fs AS (SELECT conv_id, turn, {FIRST_SQL} AS first_sentence FROM pairs)")


@register("answer_rules_all", sql=RULES_SQL + "SELECT conv_id, turn, " + ", ".join(
    f"{_rule_sql('first_sentence', w, n)} AS {r}" for r, w, n in C.ANSWER_RULES) + " FROM fs")
def answer_rules_all(spark, d):
    p = answer_pairs(spark, d).select("conv_id", "turn", first_sentence(F.col("answer")).alias("fs"))
    return p.select("conv_id", "turn", *[_rule_col(F.col("fs"), w, n).alias(r) for r, w, n in C.ANSWER_RULES])


_BY = {r: (w, n) for r, w, n in C.ANSWER_RULES}


@register("answer_filter_chain", sql=RULES_SQL + "SELECT conv_id, turn, first_sentence FROM fs WHERE " + " AND ".join(
    [f"{_rule_sql('first_sentence', *_BY[r])} = 0" for r in C.ANSWER_REJECT] + [f"{_rule_sql('first_sentence', *_BY[C.ANSWER_ACCEPT])} = 1"]))
def answer_filter_chain(spark, d):
    p = answer_pairs(spark, d).select("conv_id", "turn", first_sentence(F.col("answer")).alias("first_sentence"))
    cond = F.lit(True)
    for r in C.ANSWER_REJECT:
        cond = cond & (_rule_col(F.col("first_sentence"), *_BY[r]) == 0)
    cond = cond & (_rule_col(F.col("first_sentence"), *_BY[C.ANSWER_ACCEPT]) == 1)
    return p.filter(cond)


SHORT_LINES = 16  # fixed value: lines kept in the shortened text


def short_text(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(l, r"^[!-/:-@\[-`{-~ \t]+", ""))
    kept = F.filter(lines, lambda l: F.trim(l) != "")
    return F.array_join(F.slice(kept, 1, SHORT_LINES), "\n")


SHORT_SQL = ("array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), "
             "lambda l: regexp_replace(l, '^[!-/:-@\\[-`{-~ \\t]+', '')), lambda l: trim(l) <> ''), 1, "
             f"{SHORT_LINES}), chr(10))")


@register("short_text", sql=f"SELECT doc_id, {SHORT_SQL} AS short_text FROM documents")
def short_text_q(spark, d):
    return V.table(spark, d, "documents").select("doc_id", short_text(F.col("text")).alias("short_text"))


TOKEN_RX = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\r\n]"


@register("token_cost", sql=f"""
SELECT CAST(sum(len(regexp_extract_all(text, '({TOKEN_RX})', 1))) AS BIGINT) AS tokens_full,
       CAST(sum(len(regexp_extract_all({SHORT_SQL}, '({TOKEN_RX})', 1))) AS BIGINT) AS tokens_short,
       round(CAST(sum(len(regexp_extract_all(text, '({TOKEN_RX})', 1))) AS DOUBLE) * {C.TOKEN_PRICE_PER_1K / 1000!r}, 6) AS cost_full,
       round(CAST(sum(len(regexp_extract_all({SHORT_SQL}, '({TOKEN_RX})', 1))) AS DOUBLE) * {C.TOKEN_PRICE_PER_1K / 1000!r}, 6) AS cost_short
FROM documents""")
def token_cost(spark, d):
    docs = V.table(spark, d, "documents")
    full = X.count_rx(F.col("text"), TOKEN_RX)
    short = X.count_rx(short_text(F.col("text")), TOKEN_RX)
    g = docs.agg(F.sum(full).cast("bigint").alias("tokens_full"), F.sum(short).cast("bigint").alias("tokens_short"))
    rate = C.TOKEN_PRICE_PER_1K / 1000
    return g.select("tokens_full", "tokens_short", X.r6(F.col("tokens_full") * rate).alias("cost_full"),
                    X.r6(F.col("tokens_short") * rate).alias("cost_short"))


PROMPT_TEMPLATE = "Does the article quote the person directly? Answer yes or no.\n\n%s"
EDGE_SPACE = r"^[ \t\r\n]+|[ \t\r\n]+$"


@register("prompt_table", sql=PRESELECT_SQL + f"""
SELECT article_id, {S.q(C.PROMPT_MODEL)} AS model, {C.PROMPT_SEED} AS seed, CAST({C.PROMPT_TEMPERATURE} AS DOUBLE) AS temperature,
       'Does the article quote the person directly? Answer yes or no.' || chr(10) || chr(10)
       || regexp_replace(text, {S.q(EDGE_SPACE)}, '', 'g') AS prompt
FROM sel WHERE selected = 1""")
def prompt_table(spark, d):
    """One prompt per selected article, with its whole trimmed text."""
    chosen = preselected(spark, d).filter("selected = 1")
    return chosen.select("article_id", F.lit(C.PROMPT_MODEL).alias("model"), F.lit(C.PROMPT_SEED).alias("seed"),
                         F.lit(C.PROMPT_TEMPERATURE).alias("temperature"),
                         F.format_string(PROMPT_TEMPLATE, F.regexp_replace("text", EDGE_SPACE, "")).alias("prompt"))
