"""Rules I23 and I24 over whole articles. The rule families over the lemmatised passage are in ``q_features``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import rules as RU

ART = S.ART


STEM_HIT_SQL = S.stem_hit_sql("a.text", "a.stem")


def _w(name):
    return f"regexp_matches(a.text, {S.q(S.prefix_rx(C.INTERVIEW_WORDS[name]))})"


@register("rule_interview", sql=S.with_(ART) + f"""
SELECT a.article_id,
  CAST({_w('interview')} OR ({_w('ask')} OR {_w('answer1')} OR {_w('asking')} OR ({_w('answering')} AND {_w('question')}))
       OR ({_w('talk')} AND {STEM_HIT_SQL}) AS INTEGER) AS interview_literal,
  CAST((({_w('interview')} OR {_w('ask')} OR {_w('answer1')} OR {_w('asking')} OR {_w('answering')}) AND {_w('question')})
       OR ({_w('talk')} AND {STEM_HIT_SQL}) AS INTEGER) AS interview_meant
FROM art a""")
def rule_interview(spark, d):
    a = V.articles(spark, d)
    hit = F.regexp_like(F.col("text"), X.stem_hit_rx(F.col("stem")))
    return a.select("article_id", *[c.alias(k) for k, c in RU.interview_flags(F.col("text"), hit).items()])


@register("rule_meeting", sql=S.with_(ART) + f"""
SELECT a.article_id, CAST(regexp_matches(a.text, {S.q(S.prefix_rx(C.MEETING_RULE['names']))})
  AND regexp_matches(a.text, {S.q(S.prefix_rx(C.MEETING_RULE['title']))}) AS INTEGER) AS meeting FROM art a""")
def rule_meeting(spark, d):
    a = V.articles(spark, d)
    flag = RU.any_word(F.col("text"), C.MEETING_RULE["names"]) & RU.any_word(F.col("text"), C.MEETING_RULE["title"])
    return a.select("article_id", flag.cast("int").alias("meeting"))
