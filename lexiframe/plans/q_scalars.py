"""Scalar expressions H1-H19, each run over a whole table so that its work grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X

_PROX = ("the", "of", 3)  # fixed value: proximity test words and gap


def _docs(spark, d):
    return V.table(spark, d, "documents")


@register("str_case_contains", sql="SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) AS has_term FROM documents")
def str_case_contains(spark, d):
    return _docs(spark, d).select("doc_id", F.lower("text").contains("the").cast("int").alias("has_term"))


@register("rx_prefix", sql=f"SELECT doc_id, CAST(regexp_matches(text, {S.q(S.prefix_rx('ent'))}) AS INTEGER) AS hit FROM documents")
def rx_prefix(spark, d):
    return _docs(spark, d).select("doc_id", F.col("text").rlike(X.prefix_rx("ent")).cast("int").alias("hit"))


@register("rx_word", sql=f"SELECT doc_id, CAST(regexp_matches(text, {S.q(S.word_rx('ent'))}) AS INTEGER) AS hit FROM documents")
def rx_word(spark, d):
    return _docs(spark, d).select("doc_id", F.col("text").rlike(X.word_rx("ent")).cast("int").alias("hit"))


@register("rx_proximity", sql=f"SELECT doc_id, CAST(regexp_matches(text, {S.q(S.proximity_rx(*_PROX))}) AS INTEGER) AS hit FROM documents")
def rx_proximity(spark, d):
    return _docs(spark, d).select("doc_id", F.col("text").rlike(X.proximity_rx(*_PROX)).cast("int").alias("hit"))


@register("rx_replace", sql="""
SELECT doc_id, length(regexp_replace(text, '[0-9]+', '', 'g')) AS n_without_digits,
       md5(regexp_replace(lower(text), '[^\\p{L} ]+', ' ', 'g')) AS cleaned_digest FROM documents""")
def rx_replace(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.length(F.regexp_replace(t, "[0-9]+", "")).alias("n_without_digits"),
                                  F.md5(F.regexp_replace(F.lower(t), r"[^\p{L} ]+", " ")).alias("cleaned_digest"))


@register("rx_findall_ints", sql="""
SELECT doc_id, TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS first_int,
       len(regexp_extract_all(text, '([0-9]+)', 1)) AS n_ints FROM documents""")
def rx_findall_ints(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.regexp_extract(t, "([0-9]+)", 1).try_cast("bigint").alias("first_int"),
                                  X.count_rx(t, "[0-9]+").alias("n_ints"))


@register("str_has_digit", sql="SELECT doc_id, CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS has_digit FROM documents")
def str_has_digit(spark, d):
    return _docs(spark, d).select("doc_id", F.col("text").rlike("[0-9]").cast("int").alias("has_digit"))


@register("str_split_part", sql="""
SELECT page_id, split_part(url, '/', 3) AS host, split_part(split_part(url, '/', 3), '.', 1) AS sub FROM pages""")
def str_split_part(spark, d):
    p = V.table(spark, d, "pages")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return p.select("page_id", host.alias("host"), F.split_part(host, F.lit("."), F.lit(1)).alias("sub"))


@register("str_pad_join", sql=f"""
SELECT c_custkey, {S.pad_id('c_custkey')} AS cik, replace(c_name, '#', '') AS name_plain,
       'data/' || {S.pad_id('c_custkey')} || '/' || replace(c_name, '#', '') || '.json' AS path FROM customer""")
def str_pad_join(spark, d):
    c = V.table(spark, d, "customer")
    cik = X.pad_id("c_custkey")
    plain = F.replace("c_name", F.lit("#"), F.lit(""))
    return c.select("c_custkey", cik.alias("cik"), plain.alias("name_plain"),
                    F.concat(F.lit("data/"), cik, F.lit("/"), plain, F.lit(".json")).alias("path"))


@register("str_strip_punct", sql="SELECT doc_id, length(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')) AS n_chars FROM documents")
def str_strip_punct(spark, d):
    return _docs(spark, d).select("doc_id", F.length(X.strip_punct(F.col("text"))).alias("n_chars"))


@register("str_count_char", sql="""
SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e, length(text) - length(replace(text, chr(10), '')) AS n_lines
FROM documents""")
def str_count_char(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.count_char(t, "e").alias("n_e"), X.count_char(t, "\n").alias("n_lines"))


@register("date_extract", sql=S.with_(S.ART) + """
SELECT article_id, CAST(try_strptime(regexp_extract('Date: ' || strftime(date, '%d.%m.%Y') || chr(10) || text,
       'Date: ([0-9]{2}\\.[0-9]{2}\\.[0-9]{4})', 1), '%d.%m.%Y') AS DATE) AS date FROM art""")
def date_extract(spark, d):
    a = V.dated_articles(spark, d)
    raw = F.regexp_extract("raw_text", r"Date: ([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1)
    return a.select("article_id", F.try_to_date(raw, "dd.MM.yyyy").alias("date"))


@register("date_parts", sql=S.with_(S.ART) + "SELECT article_id, year(date) AS year, quarter(date) AS quarter, month(date) AS month FROM art")
def date_parts(spark, d):
    a = V.articles(spark, d)
    return a.select("article_id", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"))


@register("date_clamp_months", sql="""
WITH t AS (SELECT n_name AS entity,
                  strftime(DATE '1995-01-01' + CAST(n_nationkey * 61 AS INTEGER), '%d/%m/%Y') AS entry_s,
                  strftime(DATE '1995-01-01' + CAST(n_nationkey * 61 + 700 + n_nationkey * 37 AS INTEGER), '%d/%m/%Y') AS end_s FROM nation),
c AS (SELECT entity, greatest(CAST(strptime(entry_s, '%d/%m/%Y') AS DATE), DATE '1996-01-01') AS lo,
             least(CAST(strptime(end_s, '%d/%m/%Y') AS DATE), DATE '1998-12-31') AS hi FROM t)
SELECT entity, strftime(lo, '%Y-%m-%d') AS start_date, strftime(CAST(lo + INTERVAL 3 MONTH AS DATE), '%Y-%m-%d') AS start_plus_3m,
       (year(lo) - 2000) * 12 + month(lo) - 1 AS start_idx, (year(hi) - 2000) * 12 + month(hi) - 1 AS end_idx FROM c""")
def date_clamp_months(spark, d):
    from ..operators import panel as P
    t = P.tenure(spark, d).select("entity", F.date_format("entry_date", "dd/MM/yyyy").alias("entry_s"),
                                  F.date_format("end_date", "dd/MM/yyyy").alias("end_s"))
    lo = F.greatest(F.to_date("entry_s", "dd/MM/yyyy"), F.lit("1996-01-01").cast("date"))
    hi = F.least(F.to_date("end_s", "dd/MM/yyyy"), F.lit("1998-12-31").cast("date"))
    c = t.select("entity", lo.alias("lo"), hi.alias("hi"))
    return c.select("entity", F.date_format("lo", "yyyy-MM-dd").alias("start_date"),
                    F.date_format(F.add_months("lo", 3), "yyyy-MM-dd").alias("start_plus_3m"),
                    P.month_index(F.col("lo")).alias("start_idx"), P.month_index(F.col("hi")).alias("end_idx"))


@register("math_squares", sql="SELECT doc_id, n_chars * n_chars AS n_chars_sq, CAST(len(string_split(text, ' ')) AS BIGINT) * len(string_split(text, ' ')) AS words_sq FROM documents")
def math_squares(spark, d):
    w = F.size(F.split("text", " ")).cast("bigint")
    return _docs(spark, d).select("doc_id", (F.col("n_chars") * F.col("n_chars")).alias("n_chars_sq"), (w * w).alias("words_sq"))


@register("math_ratio_clip_root", sql=f"""
SELECT doc_id, round(least(CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) / nullif(len({S.space_tokens_sql('text')}), 0), 0.3), 6) AS comma_share_capped,
       CAST(ceil(n_chars / 1000.0) AS BIGINT) AS kchars, round(sqrt(n_chars), 3) AS root_chars FROM documents""")
def math_ratio_clip_root(spark, d):
    t = F.col("text")
    share = F.least(X.safe_div(X.count_char(t, ","), F.size(X.space_tokens(t))), F.lit(0.3))
    return _docs(spark, d).select("doc_id", X.r6(share).alias("comma_share_capped"),
                                  F.ceil(F.col("n_chars") / 1000.0).cast("bigint").alias("kchars"),
                                  F.round(F.sqrt("n_chars"), 3).alias("root_chars"))


@register("array_ops", sql=f"""
SELECT doc_id, len(list_filter(t, lambda x: length(x) > 3)) AS n_long, len(list_distinct(t)) AS n_distinct,
       array_to_string(list_transform(t[1:3], lambda x: CAST(length(x) AS VARCHAR)), ' ') AS head_lengths,
       CAST(len(list_filter(t, lambda x: length(x) >= 20)) = 0 AS INTEGER) AS all_short,
       CAST(list_contains(t, 'the') AS INTEGER) AS any_the
FROM (SELECT doc_id, {S.word_tokens_sql('text')} AS t FROM documents)""")
def array_ops(spark, d):
    t = X.word_tokens(F.col("text"))
    docs = _docs(spark, d).select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size(F.filter("t", lambda x: F.length(x) > 3)).alias("n_long"),
                       F.size(F.array_distinct("t")).alias("n_distinct"),
                       F.array_join(F.transform(F.slice("t", 1, 3), lambda x: F.length(x).cast("string")), " ").alias("head_lengths"),
                       F.forall("t", lambda x: F.length(x) < 20).cast("int").alias("all_short"),
                       F.exists("t", lambda x: x == "the").cast("int").alias("any_the"))


@register("first_sentence", sql=f"SELECT conv_id, turn, coalesce({S.sentences_sql('text')}[1], '') AS first_sentence FROM conversations")
def first_sentence(spark, d):
    from .q_answers import first_sentence as fs
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", fs(F.col("text")).alias("first_sentence"))


#: the upper half of code page 1251, character by byte (the one free byte stands for itself), and of Latin-1
CP1251 = "".join(bytes([b]).decode("cp1251") if b != 0x98 else chr(b) for b in range(128, 256))
LATIN1 = "".join(map(chr, range(128, 256)))


def damage_mojibake(text):
    """UTF-8 bytes read as code page 1251."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), LATIN1, CP1251)


def repair_mojibake(text):
    """Text whose UTF-8 bytes had been read as code page 1251, put right; other text is left as it is."""
    raw = F.encode(F.translate(text, CP1251, LATIN1), "ISO-8859-1")
    foreign = F.translate(text, CP1251 + "".join(map(chr, range(128))), "") != ""
    return F.when(~foreign & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


@register("repair_mojibake", sql="SELECT doc_id, text AS repaired, text AS untouched FROM documents")
def repair_mojibake_q(spark, d):
    docs = V.table(spark, d, "documents")
    damaged = docs.select("doc_id", "text", damage_mojibake(F.col("text")).alias("damaged"))
    return damaged.select("doc_id", repair_mojibake(F.col("damaged")).alias("repaired"), repair_mojibake(F.col("text")).alias("untouched"))
