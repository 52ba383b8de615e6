"""Filing jobs A4-A9, B12-B13, C9-C10, D13-D14, E4, E8, E10, L1-L4.

The filing payloads are JSON documents built from lineitem/orders (one facts document per report,
one filings document per company and block of 1024 order keys, one frame document per fact, frame
and block), then parsed back with ``from_json``: the parse path is the operator, the oracle reads the
flat tables directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import filings as FI

FACTS_SQL = f"""
facts AS (
  SELECT o.o_custkey AS company, f.fact, u.unit, CAST(l.l_shipdate AS DATE) AS end_date, l.l_extendedprice AS val,
         {S.pad_id('l.l_orderkey')} AS accn, year(o.o_orderdate) AS fy, o.o_orderpriority AS form,
         CASE WHEN l.l_linestatus = 'F' THEN 'CY' || CAST(year(l.l_shipdate) AS VARCHAR) END AS frame,
         l.l_orderkey, l.l_linenumber, CAST(o.o_orderdate AS DATE) AS filed
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN {S.values(C.FACT_BY_FLAG, ['l_returnflag', 'fact'], 'f')} ON f.l_returnflag = l.l_returnflag
  JOIN {S.values(C.UNIT_BY_STATUS, ['l_linestatus', 'unit'], 'u')} ON u.l_linestatus = l.l_linestatus)"""

FACT_NAMES = [f for _, f in C.FACT_BY_FLAG]


def facts_documents(spark, d):
    """(company, report, json): one company-facts document per report, nested fact -> unit -> rows."""
    f = V.facts(spark, d)
    obs = F.struct(F.col("end").alias("end"), "val", "accn", "fy", "form", "frame")
    rows = f.groupBy("company", "l_orderkey").agg(F.collect_list(F.struct("fact", "unit", obs.alias("o"))).alias("r"))
    doc = F.expr("""
      map_from_arrays(
        array_distinct(transform(r, x -> x.fact)),
        transform(array_distinct(transform(r, x -> x.fact)), fa -> named_struct('units',
          map_from_arrays(
            array_distinct(transform(filter(r, x -> x.fact = fa), x -> x.unit)),
            transform(array_distinct(transform(filter(r, x -> x.fact = fa), x -> x.unit)),
                      un -> transform(filter(r, x -> x.fact = fa AND x.unit = un), x -> x.o))))))""")
    return rows.select("company", "l_orderkey", F.to_json(doc).alias("json"))


@register("json_facts", sql=S.with_(FACTS_SQL) + """
SELECT company, fact, unit, end_date, val, accn, fy, form, frame FROM facts""")
def json_facts(spark, d):
    out = FI.parse_facts(facts_documents(spark, d), "json", keep=["company"])
    return out.select("company", "fact", "unit", F.col("end").alias("end_date"), "val", "accn", "fy", "form", "frame")


@register("json_keys", sql=S.with_(FACTS_SQL) + "SELECT DISTINCT fact FROM facts")
def json_keys(spark, d):
    docs = facts_documents(spark, d)
    return docs.select(F.explode(F.json_object_keys("json")).alias("fact")).distinct()


@register("json_records", sql="""
SELECT e.event_id, k AS key, CAST(json_extract_string(e.props, '$."' || k || '"') AS BIGINT) AS value
FROM events e, unnest(json_keys(e.props)) AS t(k)""")
def json_records(spark, d):
    e = V.table(spark, d, "events")
    m = e.select("event_id", F.explode(F.from_json("props", "map<string, bigint>")).alias("key", "value"))
    return m


def filings_documents(spark, d):
    o = V.table(spark, d, "orders")
    rows = o.select(
        "o_custkey", F.floor(F.col("o_orderkey") / 1024).alias("block"),
        F.struct("o_orderkey", F.col("o_orderpriority").alias("form"),
                 F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100,
                                 F.col("o_orderkey")).alias("acc"),
                 F.format_string("doc%d.htm", F.col("o_orderkey")).alias("doc")).alias("r"))
    g = rows.groupBy("o_custkey", "block").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    doc = F.struct(F.transform("rs", lambda x: x["form"]).alias("form"),
                   F.transform("rs", lambda x: x["acc"]).alias("accessionNumber"),
                   F.transform("rs", lambda x: x["doc"]).alias("primaryDocument"))
    return g.select(F.col("o_custkey").alias("company"), F.to_json(doc).alias("json"))


@register("json_columnar", sql="""
SELECT o_custkey AS company, o_orderpriority AS form,
       format('{:010d}-{:02d}-{:06d}', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accession_number,
       'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document FROM orders""")
def json_columnar(spark, d):
    return FI.parse_columnar(filings_documents(spark, d), "json", keep=["company"])


@register("json_frames", sql=S.with_(FACTS_SQL) + """
SELECT fact, frame, company AS cik, accn, end_date, val FROM facts WHERE frame IS NOT NULL""")
def json_frames(spark, d):
    f = V.facts(spark, d).filter(F.col("frame").isNotNull())
    g = f.groupBy("fact", "frame", F.floor(F.col("l_orderkey") / 1024).alias("block")).agg(
        F.collect_list(F.struct(F.col("company").alias("cik"), "accn", F.col("end").alias("end"), "val")).alias("data"))
    docs = g.select(F.to_json(F.struct(F.col("fact").alias("tag"), "frame", "data")).alias("json"))
    return FI.parse_frame(docs, "json").select("fact", "frame", "cik", "accn", F.col("end").alias("end_date"), "val")


@register("filter_framed", sql=S.with_(FACTS_SQL) + "SELECT company, fact, frame, accn, val FROM facts WHERE frame IS NOT NULL")
def filter_framed(spark, d):
    return V.facts(spark, d).filter(F.col("frame").isNotNull()).select("company", "fact", "frame", "accn", "val")


@register("dedupe_last", sql=S.with_(FACTS_SQL) + """
SELECT accn, fy, fact, end_date, val FROM (
  SELECT *, row_number() OVER (PARTITION BY accn, fy, fact ORDER BY end_date DESC, val DESC, unit DESC, l_linenumber DESC) rn
  FROM facts) WHERE rn = 1""")
def dedupe_last(spark, d):
    f = V.facts(spark, d).select("accn", "fy", "fact", F.col("end").alias("end_date"), "val", "unit", "l_linenumber")
    return FI.latest_by(f, ["accn", "fy", "fact"], ["end_date", "val", "unit", "l_linenumber"], ["end_date", "val"])


@register("latest_fact", sql=S.with_(FACTS_SQL) + """
SELECT company, fact, arg_max(val, (fy, end_date, accn, val)) AS val, arg_max(accn, (fy, end_date, accn, val)) AS accn
FROM facts GROUP BY ALL""")
def latest_fact(spark, d):
    f = V.facts(spark, d).withColumnRenamed("end", "end_date")
    return FI.latest_by(f, ["company", "fact"], ["fy", "end_date", "accn", "val"], ["val", "accn"])


def _annual(spark, d):
    f = V.facts(spark, d).filter(F.col("form") == C.ANNUAL_FORM).select(
        "company", "accn", "fy", "fact", F.col("end").alias("end_date"), "val", "unit", "l_linenumber")
    last = FI.latest_by(f, ["company", "accn", "fy", "fact"], ["end_date", "val", "unit", "l_linenumber"], ["end_date", "val"])
    return FI.latest_by(last, ["company", "fact"], ["fy", "end_date", "accn", "val"], ["val", "accn", "fy"])


@register("annual_facts", sql=S.with_(FACTS_SQL) + f""",
last AS (SELECT company, accn, fy, fact, end_date, val FROM (
  SELECT *, row_number() OVER (PARTITION BY company, accn, fy, fact ORDER BY end_date DESC, val DESC, unit DESC, l_linenumber DESC) rn
  FROM facts WHERE form = {S.q(C.ANNUAL_FORM)}) WHERE rn = 1)
SELECT company, fact, arg_max(val, (fy, end_date, accn, val)) AS val, arg_max(accn, (fy, end_date, accn, val)) AS accn,
       arg_max(fy, (fy, end_date, accn, val)) AS fy FROM last GROUP BY ALL""")
def annual_facts(spark, d):
    return _annual(spark, d)


UNIT = "USD"

# annual reports in one unit; of a report's values for a fact the latest
ANNUAL_SQL = f"""
last AS (SELECT company, accn, fy, fact, end_date, val FROM (
  SELECT *, row_number() OVER (PARTITION BY company, accn, fy, fact ORDER BY end_date DESC, val DESC, l_linenumber DESC) rn
  FROM facts WHERE form = {S.q(C.ANNUAL_FORM)} AND unit = {S.q(UNIT)}) WHERE rn = 1),
newest AS (SELECT company, max(struct_pack(fy := fy, accn := accn)) AS r FROM last GROUP BY company)"""


def annual_values(spark, d):
    """(company, accn, fy, fact, end_date, val): one value per annual report and fact, in one unit."""
    f = V.facts(spark, d).filter((F.col("form") == C.ANNUAL_FORM) & (F.col("unit") == UNIT)).withColumnRenamed("end", "end_date")
    return FI.latest_by(f, ["company", "accn", "fy", "fact"], ["end_date", "val", "l_linenumber"], ["end_date", "val"])


def _wide_sql() -> str:
    return ", ".join(f"round(max(CASE WHEN fact = {S.q(n)} THEN val END), 6) AS {n}" for n in FACT_NAMES)


@register("fact_wide", sql=S.with_(FACTS_SQL, ANNUAL_SQL) + f"""
SELECT l.company, l.accn, l.fy, {_wide_sql()} FROM last l JOIN newest n ON n.company = l.company AND n.r.accn = l.accn AND n.r.fy = l.fy
GROUP BY ALL""")
def fact_wide(spark, d):
    """The latest annual report of each company, a column per fact."""
    v = annual_values(spark, d)
    newest = v.groupBy("company").agg(F.max(F.struct("fy", "accn")).alias("r")).select("company", "r.fy", "r.accn")
    w = FI.wide_metrics(v.join(newest, ["company", "fy", "accn"]), ["company", "accn", "fy"], "fact", "val", FACT_NAMES)
    return w.select("company", "accn", "fy", *[F.round(F.col(n), 6).alias(n) for n in FACT_NAMES])


@register("company_matrix", sql=S.with_(FACTS_SQL, ANNUAL_SQL, f"""py AS (SELECT company, fy, fact, arg_max(val, (accn, end_date)) AS val FROM last GROUP BY ALL),
cm AS (SELECT company, fy, {_wide_sql()} FROM py GROUP BY ALL)""") + f"""
SELECT company, fy, {', '.join(FACT_NAMES)},
       {', '.join(f"lag({n}, 1) OVER (PARTITION BY company ORDER BY fy) AS {n}_t1" for n in FACT_NAMES)},
       {', '.join(f"lag({n}, 2) OVER (PARTITION BY company ORDER BY fy) AS {n}_t2" for n in FACT_NAMES)}
FROM cm""")
def company_matrix(spark, d):
    """A company's years side by side: of a year's annual reports the last, with the two years before."""
    year = FI.latest_by(annual_values(spark, d), ["company", "fy", "fact"], ["accn", "end_date"], ["val"])
    w = FI.wide_metrics(year, ["company", "fy"], "fact", "val", FACT_NAMES)
    w = w.select("company", "fy", *[F.round(F.col(n), 6).alias(n) for n in FACT_NAMES])
    return FI.lagged(w, "company", "fy", FACT_NAMES, (1, 2))


@register("lagged_reports", sql="""
SELECT company, fy, n_reports, total, lag(total, 1) OVER (PARTITION BY company ORDER BY fy) AS total_t1,
       lag(total, 2) OVER (PARTITION BY company ORDER BY fy) AS total_t2
FROM (SELECT o_custkey AS company, year(o_orderdate) AS fy, count(*) AS n_reports, round(sum(o_totalprice), 6) AS total
      FROM orders GROUP BY ALL)""")
def lagged_reports(spark, d):
    o = V.table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fy")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.round(F.sum("o_totalprice"), 6).alias("total"))
    return FI.lagged(per, "company", "fy", ["total"], (1, 2))


@register("report_fact_join", sql=S.with_(FACTS_SQL) + """
SELECT f.company, f.accn, o.o_orderpriority AS form, f.fact, f.val
FROM facts f JOIN orders o ON o.o_custkey = f.company AND o.o_orderkey = f.l_orderkey""")
def report_fact_join(spark, d):
    f = V.facts(spark, d).select("company", "accn", "l_orderkey", "fact", "val")
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("l_orderkey"),
                                           F.col("o_orderpriority").alias("form"))
    return f.join(o, ["company", "l_orderkey"]).select("company", "accn", "form", "fact", "val")


@register("filing_paths", sql=f"""
SELECT o_orderkey AS report, {S.pad_id('o_custkey')} AS cik_padded,
       replace(format('{{:010d}}-{{:02d}}-{{:06d}}', o_custkey, year(o_orderdate) % 100, o_orderkey), '-', '') AS accession_plain,
       'edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || replace(format('{{:010d}}-{{:02d}}-{{:06d}}', o_custkey, year(o_orderdate) % 100, o_orderkey), '-', '') || '/doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS document_path,
       'edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || format('{{:010d}}-{{:02d}}-{{:06d}}', o_custkey, year(o_orderdate) % 100, o_orderkey) || '.txt' AS text_path
FROM orders""")
def filing_paths(spark, d):
    o = V.table(spark, d, "orders")
    acc = F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100, F.col("o_orderkey"))
    plain = F.replace(acc, F.lit("-"), F.lit(""))
    cik = F.col("o_custkey").cast("string")
    return o.select(F.col("o_orderkey").alias("report"), X.pad_id("o_custkey").alias("cik_padded"), plain.alias("accession_plain"),
                    F.concat(F.lit("edgar/data/"), cik, F.lit("/"), plain, F.lit("/doc"), F.col("o_orderkey").cast("string"),
                             F.lit(".htm")).alias("document_path"),
                    F.concat(F.lit("edgar/data/"), cik, F.lit("/"), acc, F.lit(".txt")).alias("text_path"))


PRICES_SQL = """
prices AS (SELECT l_partkey AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
           FROM lineitem GROUP BY ALL),
qs AS (SELECT DISTINCT l.l_orderkey AS report, l.l_partkey AS ticker, CAST(o.o_orderdate AS DATE) AS filed
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
q AS (SELECT report, ticker, h AS horizon, CAST(filed + to_months(h) AS DATE) AS target FROM qs, unnest([0, 3, 6, 12]) AS t(h))"""

HORIZONS = [0, 3, 6, 12]


def price_queries(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    qs = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("ticker"), F.to_date("o_orderdate").alias("filed")).distinct()
    q = qs.select("report", "ticker", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"), "filed")
    return q.select("report", "ticker", "horizon", F.add_months("filed", F.col("horizon")).alias("target"))


def asof_rows(spark, d) -> int:
    """Queries and prices together, at most: a query for each line and horizon, and a price for each line."""
    return V.table(spark, d, "lineitem").count() * (len(HORIZONS) + 1)


@register("asof_price", sql=S.with_(PRICES_SQL) + """
SELECT q.report, q.ticker, q.horizon, a.close AS close_after, b.close AS close_before
FROM q ASOF LEFT JOIN prices a ON a.ticker = q.ticker AND a.date >= q.target
       ASOF LEFT JOIN prices b ON b.ticker = q.ticker AND b.date < q.target""")
def asof_price(spark, d):
    q = price_queries(spark, d)
    p = V.prices(spark, d)
    return FI.asof(q, p, "ticker", "target", "date", "close", n_rows=asof_rows(spark, d)).select(
        "report", "ticker", "horizon", "close_after", "close_before")


@register("performance_targets", sql=S.with_(PRICES_SQL) + """,
a AS (SELECT q.report, q.ticker, q.horizon, p.close FROM q ASOF LEFT JOIN prices p ON p.ticker = q.ticker AND p.date >= q.target)
SELECT report, ticker,
       round(max(CASE WHEN horizon = 3 THEN close END) / max(CASE WHEN horizon = 0 THEN close END) - 1, 6) AS ret_3m,
       round(max(CASE WHEN horizon = 6 THEN close END) / max(CASE WHEN horizon = 0 THEN close END) - 1, 6) AS ret_6m,
       round(max(CASE WHEN horizon = 12 THEN close END) / max(CASE WHEN horizon = 0 THEN close END) - 1, 6) AS ret_12m
FROM a GROUP BY report, ticker""")
def performance_targets(spark, d):
    """A report's dates stay in one row: rows meet their ticker's list of prices, and every horizon is looked up there, so
    that neither horizons nor prices are exchanged as rows of an as-of join."""
    parts = -(-V.table(spark, d, "lineitem").count() // 1_000_000)

    def dealt(df, *keys):  # about a million rows a task, however many there are
        return df.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    li = dealt(V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    o = dealt(V.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filed")), "o_orderkey")
    key = [F.coalesce("ticker", F.lit(0)).alias("_k"), F.col("ticker").isNull().alias("_none")]
    q = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("ticker")).agg(
        F.collect_set(F.struct("filed")).alias("_filed"))
    q = dealt(q.select("*", *key), "_k", "_none")
    p = FI.value_lists(dealt(V.prices(spark, d).select(*key, "date", "close"), "_k", "_none"), "date", "close")

    def close(h):
        return F.array_max(F.transform("_filed", lambda f: FI.value_from(F.add_months(f["filed"], h), F.col("_none"))))

    w = q.join(p, ["_k", "_none"], "left").select("report", "ticker", *[close(h).alias(str(h)) for h in HORIZONS])
    return w.select("report", "ticker", *[F.round(F.col(str(h)) / F.col("0") - 1, 6).alias(f"ret_{h}m") for h in HORIZONS[1:]])


@register("period_return", sql="""
WITH prices AS (SELECT l_partkey AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
                FROM lineitem GROUP BY ALL)
SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close,
       round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS period_return
FROM prices WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY ticker""")
def period_return(spark, d):
    return FI.period_return(V.prices(spark, d), "ticker", "date", "close", "1996-01-01", "1996-12-31")


_HTML_SQL = "html"
for _rx in [r"(?is)<table\b.*?</table>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"]:
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, {S.q(_rx)}, ' ', 'g')"
for _ent, _ch in FI.HTML_ENTITIES:
    _HTML_SQL = f"replace({_HTML_SQL}, {S.q(_ent)}, {S.q(_ch)})"


@register("html_text", sql=f"SELECT page_id, trim(regexp_replace({_HTML_SQL}, '{S.SP}+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", FI.html_text(F.col("html")).alias("text"))

