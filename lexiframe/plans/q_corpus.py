"""Sources, projections, joins, dedupe, ordering and set operations over the article spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import corpus as CO
from ..operators import namesakes as NS
from ..sources import tables as TB

ART = S.ART

# ---------------------------------------------------------------- sources


@register("src_table", sql="SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_table(spark, d):
    return TB.read_table(spark, f"{d}/events.parquet", V.EVENTS_SCHEMA).select(
        "event_id", "ts", "user_id", "event_type", "value", "props")


@register("src_multipart", sql="""
SELECT 1 AS part, doc_id AS id, text FROM documents
UNION ALL SELECT 2 AS part, item_id AS id, text FROM benchmark""")
def src_multipart(spark, d):
    return TB.read_parts(spark, [(1, f"{d}/documents.parquet", "doc_id"), (2, f"{d}/benchmark.parquet", "item_id")])


@register("lexicon_load", sql=S.with_(f"""
ent AS (SELECT n.n_nationkey AS entity_key, n.n_name AS entity, r.r_name AS region, s.stem, c.capital
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN {S.STEMS} ON s.entity_key = n.n_nationkey
        LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS capital FROM supplier GROUP BY 1) c
          ON c.s_nationkey = n.n_nationkey)""") + """
SELECT entity, category, term FROM (
  SELECT entity, 'name' AS category, entity AS term FROM ent
  UNION ALL SELECT entity, 'region', region FROM ent
  UNION ALL SELECT entity, 'stem', stem FROM ent
  UNION ALL SELECT entity, 'capital', capital FROM ent) WHERE term IS NOT NULL""")
def lexicon_load(spark, d):
    wide = V.nations(spark, d).join(V.capitals(spark, d), "entity_key", "left").withColumn("name", F.col("entity"))
    return TB.wide_to_long(wide, ["entity"], ["name", "region", "stem", "capital"], "category", "term")


@register("split_parts", sql=S.with_(ART) + """
SELECT article_id, ntile(13) OVER (ORDER BY article_id) AS part FROM art""")
def split_parts(spark, d):
    a = V.articles(spark, d).select("article_id")
    idx = CO.row_index(a, ["article_id"], with_total=True)
    return idx.select("article_id", CO.ntile_of("row_idx", "_total", 13).alias("part"))


@register("sink_table", sql=S.with_(ART) + """
SELECT year(date) AS year, quarter(date) AS quarter, entity, count(*) AS total_articles
FROM art GROUP BY ALL""")
def sink_table(spark, d):
    a = V.articles(spark, d)
    panel = a.groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter"), "entity").agg(
        F.count(F.lit(1)).alias("total_articles"))
    path = TB.write_table(panel, "panel_quarter_all", partition_by=["year"])
    return spark.read.parquet(path).select("year", "quarter", "entity", "total_articles")


# ---------------------------------------------------------------- projections and filters


@register("project_cols", sql=S.with_(ART) + "SELECT article_id, entity, date, publisher FROM art")
def project_cols(spark, d):
    return V.articles(spark, d).drop("text", "lang", "stem", "entity_key", "region")


@register("drop_missing", sql=S.with_(ART) + "SELECT article_id, label FROM art WHERE text IS NOT NULL AND label IS NOT NULL")
def drop_missing(spark, d):
    return V.labelled_articles(spark, d).dropna(subset=["text", "label"]).select("article_id", "label")


@register("fill_missing", sql=S.with_(ART) + "SELECT article_id, coalesce(label, 0) AS label FROM art")
def fill_missing(spark, d):
    return V.labelled_articles(spark, d).fillna({"label": 0}).select("article_id", "label")


@register("relabel_second_pass", sql=S.with_(ART) + """
SELECT article_id, CASE WHEN appointment IN (0, 1) THEN appointment ELSE label END AS label FROM art""")
def relabel_second_pass(spark, d):
    a = V.labelled_articles(spark, d)
    return a.select("article_id", F.when(F.col("appointment").isin(0, 1), F.col("appointment"))
                    .otherwise(F.col("label")).alias("label"))


@register("implied_label", sql=S.with_(ART) + """
SELECT article_id, CASE WHEN appointment = 1 THEN 1 ELSE label END AS label FROM art""")
def implied_label(spark, d):
    a = V.labelled_articles(spark, d)
    return a.select("article_id", F.when(F.col("appointment") == 1, F.lit(1)).otherwise(F.col("label")).alias("label"))


@register("patch_rows", sql=f"""
SELECT e.event_id, e.user_id, coalesce(p.event_type, e.event_type) AS event_type, coalesce(p.value, e.value) AS value
FROM events e LEFT JOIN {S.values(C.EVENT_PATCHES, ['event_id', 'event_type', 'value'], 'p')} ON p.event_id = e.event_id""")
def patch_rows(spark, d):
    e = V.table(spark, d, "events")
    patch = V.fixed(spark, C.EVENT_PATCHES, "event_id long, p_type string, p_value double")
    return e.join(patch, "event_id", "left").select(
        "event_id", "user_id", F.coalesce("p_type", "event_type").alias("event_type"),
        F.coalesce("p_value", "value").alias("value"))


@register("entity_present", sql=S.with_(ART) + """
SELECT article_id, CAST(contains(lower(text), lower(stem)) AS INTEGER) AS present,
       CASE WHEN contains(lower(text), lower(stem)) THEN text END AS kept_text FROM art""")
def entity_present(spark, d):
    a = V.articles(spark, d)
    present = F.lower("text").contains(F.lower("stem"))
    return a.select("article_id", present.cast("int").alias("present"),
                    F.when(present, F.col("text")).alias("kept_text"))


_NAMESAKE = ("of", "the", 8)  # fixed value: (context word, surname stem, max words between)


@register("namesake_exclude", sql=S.with_(ART) + f"""
SELECT article_id, CAST(regexp_matches(text, '(?:^|{S.NW})(?i:{_NAMESAKE[0]})(?:{S.NW}+{S.WD}+){{0,{_NAMESAKE[2] - 1}}}{S.NW}+(?i:{_NAMESAKE[1]})') AS INTEGER) AS excluded,
       CASE WHEN regexp_matches(text, '(?:^|{S.NW})(?i:{_NAMESAKE[0]})(?:{S.NW}+{S.WD}+){{0,{_NAMESAKE[2] - 1}}}{S.NW}+(?i:{_NAMESAKE[1]})') THEN '' ELSE text END AS text
FROM art""")
def namesake_exclude(spark, d):
    from ..functions import text as X
    ctx, sur, gap = _NAMESAKE
    rx = f"(?:^|{X.NONWORD})(?i:{ctx})(?:{X.NONWORD}+{X.WORD}+){{0,{gap - 1}}}{X.NONWORD}+(?i:{sur})"
    a = V.articles(spark, d)
    hit = F.col("text").rlike(rx)
    return a.select("article_id", hit.cast("int").alias("excluded"),
                    F.when(hit, F.lit("")).otherwise(F.col("text")).alias("text"))


def _namesake_hit(context, surname, gap):
    return f"regexp_matches(text, '(?:^|{S.NW})(?i:{context})(?:{S.NW}+{S.WD}+){{0,{gap - 1}}}{S.NW}+(?i:{surname})')"


_NAMESAKE_RULES = ", ".join(
    f"CASE WHEN {'true' if stem is None else 'stem = ' + S.q(stem)} AND {_namesake_hit(ctx, sur, gap)} THEN {S.q(rule)} END"
    for rule, stem, ctx, sur, gap in sorted(C.NAMESAKES))
_NAMESAKE_CTE = S.with_(ART) + f""",
nm AS (SELECT article_id, text, list_filter([{_NAMESAKE_RULES}], lambda r: r IS NOT NULL) AS rules FROM art)"""


def _namesakes(spark, d):
    rules = spark.createDataFrame(C.NAMESAKES, "rule string, stem string, context string, surname string, gap int")
    return NS.split(V.articles(spark, d), rules)


@register("namesake_kept", sql=_NAMESAKE_CTE + "SELECT article_id, text FROM nm WHERE len(rules) = 0")
def namesake_kept(spark, d):
    return _namesakes(spark, d)[0].select("article_id", "text")


@register("namesake_removed", sql=_NAMESAKE_CTE + "SELECT article_id, text, array_to_string(rules, ',') AS rules FROM nm WHERE len(rules) > 0")
def namesake_removed(spark, d):
    return _namesakes(spark, d)[1].select("article_id", "text", F.array_join("rules", ",").alias("rules"))


_TITLE_MARK = ".\n"  # fixed value: the first title line ends here


@register("trim_metadata", sql=S.with_(ART) + f"""
SELECT article_id, CAST(strpos(text, '.' || chr(10)) > 0 AS INTEGER) AS matched,
       trim(regexp_replace(translate(CASE WHEN strpos(text, '.' || chr(10)) > 0
                          THEN substr(text, strpos(text, '.' || chr(10)) + 2) ELSE text END, 'ç', 'c'),
                '{S.SP}+', ' ', 'g')) AS body
FROM art""")
def trim_metadata(spark, d):
    from ..functions import text as X
    a = V.articles(spark, d)
    pos = F.instr("text", _TITLE_MARK)
    body = F.when(pos > 0, F.expr(f"substr(text, instr(text, '.\\n') + {len(_TITLE_MARK)})")).otherwise(F.col("text"))
    return a.select("article_id", (pos > 0).cast("int").alias("matched"),
                    X.collapse_space(F.translate(body, "ç", "c")).alias("body"))


@register("filter_form", sql=f"""
SELECT o_custkey AS company, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
      FROM orders WHERE o_orderpriority = '{C.ANNUAL_FORM}') WHERE rn = 1""")
def filter_form(spark, d):
    o = V.table(spark, d, "orders").filter(F.col("o_orderpriority") == C.ANNUAL_FORM)
    latest = CO.dedupe_by(o.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"],
                          ["o_orderdate", "o_orderkey"], keep="last")
    return latest.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("accession"),
                         F.to_date("o_orderdate").alias("filed"))


@register("member_flag", sql=S.with_(ART) + f"""
SELECT article_id, CAST(publisher IN ({', '.join(S.q(x) for x in C.PUBLISHERS_2010)}) AS INTEGER) AS list_2010,
       CAST(publisher IN ({', '.join(S.q(x) for x in C.PUBLISHERS_2012)}) AS INTEGER) AS list_2012 FROM art""")
def member_flag(spark, d):
    a = V.articles(spark, d).select("article_id", "publisher")
    return CO.member_flags(a, "publisher", {"list_2010": C.PUBLISHERS_2010, "list_2012": C.PUBLISHERS_2012}).drop("publisher")


@register("publisher_line", sql=S.with_(ART) + "SELECT article_id, split_part(text, chr(10), 1) AS publisher_line FROM art")
def publisher_line(spark, d):
    from ..functions import text as X
    return V.articles(spark, d).select("article_id", X.first_line(F.col("text")).alias("publisher_line"))


# ---------------------------------------------------------------- joins


@register("lookup_region", sql=S.with_(ART) + """
SELECT a.article_id, a.entity, m.region FROM art a LEFT JOIN (
  SELECT n_name, arg_min(r_name, n_nationkey) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
) m ON m.n_name = a.entity""")
def lookup_region(spark, d):
    a = V.articles(spark, d).select("article_id", "entity")
    dim = CO.first_match_dim(V.nations(spark, d).select("entity", "entity_key", "region"), "entity", "entity_key")
    return a.join(F.broadcast(dim), "entity", "left").select("article_id", "entity", "region")


@register("unmatched_entities", sql="""
SELECT c.c_custkey AS customer, c.c_nationkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3)""")
def unmatched_entities(spark, d):
    c = V.table(spark, d, "customer")
    dim = V.table(spark, d, "nation").filter(F.col("n_regionkey") < 3)
    return c.join(F.broadcast(dim), c.c_nationkey == dim.n_nationkey, "left_anti").select(
        F.col("c_custkey").alias("customer"), "c_nationkey")


@register("lookup_capital", sql=S.with_(ART) + """
SELECT a.article_id, a.entity, c.capital FROM art a LEFT JOIN (
  SELECT s_nationkey, arg_min(s_name, s_suppkey) AS capital FROM supplier GROUP BY 1) c ON c.s_nationkey = a.entity_key""")
def lookup_capital(spark, d):
    a = V.articles(spark, d).select("article_id", "entity", "entity_key")
    return a.join(V.capitals(spark, d), "entity_key", "left").select("article_id", "entity", "capital")


@register("survivor_semi", sql=S.with_(ART) + """
SELECT l.doc_id, l.quality, l.toxic FROM labels l
WHERE l.doc_id IN (SELECT min(article_id) FROM art GROUP BY text, entity)""")
def survivor_semi(spark, d):
    a = V.articles(spark, d).select("article_id", F.sha2("text", 256).alias("digest"), "entity")
    keep = CO.dedupe_by(a, ["digest", "entity"], ["article_id"]).select(F.col("article_id").alias("doc_id"))
    return V.table(spark, d, "labels").join(keep, "doc_id", "left_semi")


@register("tenure_months_join", sql=S.with_(ART) + """,
ten AS (SELECT n_name AS entity, DATE '1995-01-01' + CAST(n_nationkey * 61 AS INTEGER) AS entry_date,
               DATE '1995-01-01' + CAST(n_nationkey * 61 + 700 + n_nationkey * 37 AS INTEGER) AS end_date FROM nation),
spine AS (SELECT entity, CAST(unnest(generate_series(date_trunc('month', entry_date), date_trunc('month', end_date), INTERVAL 1 MONTH)) AS DATE) AS month FROM ten)
SELECT s.entity, s.month, count(a.article_id) AS n_articles
FROM spine s LEFT JOIN art a ON a.entity = s.entity AND date_trunc('month', a.date) = s.month
GROUP BY ALL""")
def tenure_months_join(spark, d):
    from ..operators import panel as P
    spine = P.tenure_spine(spark, d)
    a = V.articles(spark, d).select("entity", F.trunc("date", "MM").alias("month"), "article_id")
    counts = a.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["entity", "month"], "left").select(
        "entity", "month", F.coalesce("n", F.lit(0)).alias("n_articles"))


# ---------------------------------------------------------------- dedupe, index, order


@register("dedupe_first", sql=S.with_(ART) + """
SELECT article_id, entity FROM (
  SELECT article_id, entity, row_number() OVER (PARTITION BY text, entity ORDER BY article_id) rn FROM art) WHERE rn = 1""")
def dedupe_first(spark, d):
    a = V.articles(spark, d).select("article_id", F.sha2("text", 256).alias("digest"), "entity")
    return CO.dedupe_by(a, ["digest", "entity"], ["article_id"]).select("article_id", "entity")


@register("row_index", sql=S.with_(ART) + """
SELECT article_id, row_number() OVER (ORDER BY date, article_id) - 1 AS row_idx FROM art""")
def row_index(spark, d):
    a = V.articles(spark, d).select("article_id", "date")
    return CO.row_index(a, ["date", "article_id"]).select("article_id", "row_idx")


@register("batch_id", sql=S.with_(ART) + """
SELECT article_id, ntile(100) OVER (ORDER BY article_id) AS batch FROM art""")
def batch_id(spark, d):
    a = V.articles(spark, d).select("article_id")
    idx = CO.row_index(a, ["article_id"], with_total=True)
    return idx.select("article_id", CO.ntile_of("row_idx", "_total", 100).alias("batch"))


@register("sort_multi", sql=S.with_(ART) + """
SELECT entity, date, article_id FROM art ORDER BY entity ASC, date DESC, article_id ASC""")
def sort_multi(spark, d):
    a = V.articles(spark, d).select("entity", "date", "article_id")
    return a.orderBy(F.asc("entity"), F.desc("date"), F.asc("article_id"))


@register("topk_value", sql="""
SELECT c_custkey AS company, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def topk_value(spark, d):
    c = V.table(spark, d, "customer")
    return c.orderBy(F.desc("c_acctbal"), F.asc("c_custkey")).limit(10).select(
        F.col("c_custkey").alias("company"), F.col("c_acctbal").alias("value"))


@register("head_n", sql=S.with_(ART) + "SELECT article_id, entity FROM art ORDER BY article_id LIMIT 100")
def head_n(spark, d):
    return V.articles(spark, d).select("article_id", "entity").orderBy("article_id").limit(100)


@register("shuffle_sample")
def shuffle_sample(spark, d, fraction: float = 1.0):
    """Whole articles in a seeded random order (hash order: engine-specific, rows-only check); a ``fraction``
    below 1 keeps the rows of the lowest part of the hash range."""
    h = F.xxhash64("article_id", F.lit(42))
    a = V.articles(spark, d).select("article_id", "entity").withColumn("_h", h)
    if fraction < 1.0:
        a = a.filter(F.col("_h") < F.lit(int(-(1 << 63) + (1 << 64) * fraction)))
    return a.orderBy("_h", "article_id").drop("_h")


# ---------------------------------------------------------------- set operations


@register("union_corpora", sql="""
SELECT 'documents' AS corpus, CAST(doc_id AS VARCHAR) AS src_id, lang, NULL AS role, length(text) AS n_chars FROM documents
UNION ALL
SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), NULL, role, length(text) FROM conversations""")
def union_corpora(spark, d):
    docs = V.table(spark, d, "documents").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("src_id"), "lang", F.length("text").alias("n_chars"))
    conv = V.table(spark, d, "conversations").select(
        F.lit("conversations").alias("corpus"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("src_id"),
        "role", F.length("text").alias("n_chars"))
    return docs.unionByName(conv, allowMissingColumns=True).select("corpus", "src_id", "lang", "role", "n_chars")


@register("rows_removed", sql="SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' OR event_type IS NULL")
def rows_removed(spark, d):
    """Rows that a filter takes away: its condition is false or unknown."""
    e = V.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.filter(~F.coalesce(F.col("event_type") != "view", F.lit(False)))


@register("distinct_entities", sql=S.with_(ART) + "SELECT DISTINCT entity FROM art")
def distinct_entities(spark, d):
    return V.articles(spark, d).select("entity").distinct()


_PERSONS = [w for w, ty in C.GAZETTEER if ty == "PER"]
_OTHERS_SQL = f"len(list_filter({S.str_list(C.ENTITY_STEMS)}, lambda s: s <> a.stem AND contains(lower(a.text), s)))"
_PERSONS_SQL = f"len(list_filter({S.word_tokens_sql('a.text')}, lambda x: list_contains({S.str_list(_PERSONS)}, x)))"
PRESELECT_SQL = S.with_(ART) + f""",
pre AS (SELECT a.article_id, a.text, length(a.text) AS text_length, {_PERSONS_SQL} AS person_count, {_OTHERS_SQL} AS other_count FROM art a),
sel AS (SELECT *, CAST(text_length > {C.PRESELECT_MIN_CHARS} AND person_count < {C.PRESELECT_MAX_PERSONS}
                       AND other_count < {C.PRESELECT_MAX_OTHERS} AS INTEGER) AS selected FROM pre)"""


def preselected(spark, d):
    """Articles with their length, person and other-entity counts, and whether the model stage takes them."""
    from ..operators import lexicon as LX
    from .q_lexicon import entity_mentions
    a = V.articles(spark, d).select("article_id", "text", "stem", F.lower("text").alias("_low"))
    out = a.select("article_id", "text", F.length("text").alias("text_length"),
                   LX.token_hits(X.word_tokens(F.col("text")), _PERSONS).alias("person_count"),
                   entity_mentions(F.col("_low"), F.col("stem")).alias("other_count"))
    sel = ((F.col("text_length") > C.PRESELECT_MIN_CHARS) & (F.col("person_count") < C.PRESELECT_MAX_PERSONS)
           & (F.col("other_count") < C.PRESELECT_MAX_OTHERS))
    return out.withColumn("selected", sel.cast("int"))


@register("preselect_flag", sql=PRESELECT_SQL + "SELECT article_id, text_length, person_count, other_count, selected FROM sel")
def preselect_flag(spark, d):
    return preselected(spark, d).drop("text")
