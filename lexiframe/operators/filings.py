"""Filing jobs: nested JSON payloads flattened with ``from_json`` + ``explode``/``inline``, latest
values, wide company x metric tables, as-of prices and returns, visible text of HTML pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

OBS = "struct<`end`: date, val: double, accn: string, fy: int, form: string, frame: string>"
FACTS_TYPE = f"map<string, struct<units: map<string, array<{OBS}>>>>"
FILINGS_TYPE = "struct<form: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>"
FRAME_TYPE = "struct<tag: string, frame: string, data: array<struct<cik: bigint, accn: string, `end`: date, val: double>>>"


def parse_facts(docs: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., fact, unit, end, val, accn, fy, form, frame) from a company-facts document."""
    m = docs.select(*keep, F.from_json(F.col(json_col), FACTS_TYPE).alias("_f"))
    by_fact = m.select(*keep, F.explode("_f").alias("fact", "_v"))
    by_unit = by_fact.select(*keep, "fact", F.explode("_v.units").alias("unit", "_obs"))
    return by_unit.select(*keep, "fact", "unit", F.inline("_obs"))


def parse_columnar(docs: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Struct of parallel arrays -> one row per position (arrays zipped, then inlined)."""
    f = docs.select(*keep, F.from_json(F.col(json_col), FILINGS_TYPE).alias("_f"))
    z = F.arrays_zip(F.col("_f.form").alias("form"), F.col("_f.accessionNumber").alias("accession_number"),
                     F.col("_f.primaryDocument").alias("primary_document"))
    return f.select(*keep, F.inline(z))


def parse_frame(docs: DataFrame, json_col: str) -> DataFrame:
    f = docs.select(F.from_json(F.col(json_col), FRAME_TYPE).alias("_f"))
    return f.select(F.col("_f.tag").alias("fact"), F.col("_f.frame").alias("frame"), F.inline("_f.data"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key, the values of the row with the largest order tuple (``max(struct)``, map-side combined)."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    return df.groupBy(*keys).agg(F.max(packed).alias("_r")).select(
        *keys, *[F.col(f"_r._v{i}").alias(v) for i, v in enumerate(values)])


def wide_metrics(df: DataFrame, keys: Sequence[str], name_col: str, value_col: str, names: Sequence[str]) -> DataFrame:
    """Company rows x metric columns; the metric list is explicit (no distinct-values pass)."""
    return df.groupBy(*keys).pivot(name_col, list(names)).agg(F.sum(value_col))


def lagged(df: DataFrame, part: str, order: str, cols: Sequence[str], lags: Sequence[int] = (1, 2)) -> DataFrame:
    """``col_t1``, ``col_t2`` ... = value k reports earlier (window per company over its reports)."""
    w = Window.partitionBy(part).orderBy(order)
    out = df
    for c in cols:
        for k in lags:
            out = out.withColumn(f"{c}_t{k}", F.lag(c, k).over(w))
    return out


def asof(queries: DataFrame, prices: DataFrame, key: str, qdate: str, pdate: str, value: str,
         direction: str | None = None, n_rows: int = 0, per_task: int = 1_000_000) -> DataFrame:
    """Nearest price on or after (``<value>_after``) and strictly before (``<value>_before``) each query date;
    ``direction`` names the one that is wanted, both by default.

    Queries and prices are one frame, exchanged once by key and year, so a hot key spans many tasks. Within a
    year each direction is a growing frame (``last(ignore nulls)`` up to the current row, once in date order and
    once in reverse). Where a year has no price on that side, the first or last price of the nearest year that
    has one is taken from a table of one row per key and year. Query rows sort before prices of their date.
    ``n_rows``: queries and prices, about; with it a task sorts ``per_task`` of them, however many there are."""
    qcols = list(queries.columns)
    q = queries.select(*qcols, F.col(qdate).alias("_d"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_v"))
    p = prices.select(*[F.lit(None).cast(queries.schema[c].dataType).alias(c) if c != key else F.col(key)
                        for c in qcols], F.col(pdate).alias("_d"), F.lit(1).alias("_kind"), F.col(value).cast("double").alias("_v"))
    u = q.unionByName(p).withColumn("_year", F.year("_d"))
    usual = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-n_rows // per_task)
    u = u.repartition(parts, key, "_year") if parts > usual else u.repartition(key, "_year")
    block = Window.partitionBy(key, "_year")
    upto = (Window.unboundedPreceding, Window.currentRow)
    near = u.withColumn("_before", F.last("_v", ignorenulls=True).over(block.orderBy("_d", "_kind").rowsBetween(*upto)))
    near = near.withColumn("_after", F.last("_v", ignorenulls=True).over(
        block.orderBy(F.desc("_d"), F.desc("_kind")).rowsBetween(*upto))).filter(F.col("_kind") == 0)
    priced = F.col("_v").isNotNull()
    years = u.groupBy(key, "_year").agg(F.min_by("_v", F.when(priced, F.col("_d"))).alias("_first"),
                                        F.max_by("_v", F.when(priced, F.col("_d"))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc("_year")).rowsBetween(Window.unboundedPreceding, -1)
    years = years.select(F.col(key).alias("_k"), F.col("_year").alias("_y"),
                         F.last("_last", ignorenulls=True).over(earlier).alias("_prev"),
                         F.last("_first", ignorenulls=True).over(later).alias("_next"))
    found = {"after": F.coalesce("_after", "_next"), "before": F.coalesce("_before", "_prev")}
    return near.join(years, (F.col(key) == F.col("_k")) & (F.col("_year") == F.col("_y")), "left").select(
        *qcols, *[c.alias(f"{value}_{k}") for k, c in found.items() if direction in (None, k)])


def value_lists(prices: DataFrame, date: str, value: str) -> DataFrame:
    """One row per key (all other columns): ``_p``, its dated values in order of date, and ``_undated``. A key has a value
    for each day at most, so a list is bounded by the calendar."""
    keys = [c for c in prices.columns if c not in (date, value)]
    entry = F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v"))
    return prices.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col(date).isNotNull(), entry))).alias("_p"),
        F.max(F.when(F.col(date).isNull(), F.col(value).cast("double"))).alias("_undated"))


def value_from(at: Column, own_year: Column) -> Column:
    """The value of ``_p`` on or after a date, found by halving; of the date's own year only, where ``own_year``. Without a
    date, ``_undated``."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_p") + 1)).cast("int"))

    def halve(a, _):
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        late = F.get(F.col("_p"), mid)["d"] < at
        return F.struct(F.when((a["lo"] < a["hi"]) & late, mid + 1).otherwise(a["lo"]).alias("lo"),
                        F.when((a["lo"] < a["hi"]) & ~late, mid).otherwise(a["hi"]).alias("hi"))

    found = F.get(F.col("_p"), F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("_p").alias("hi")), halve, lambda a: a["lo"]))
    return F.when(at.isNull(), F.col("_undated")).when(~own_year | (F.year(found["d"]) == F.year(at)), found["v"])


def period_return(prices: DataFrame, key: str, date: str, value: str, start: str, end: str) -> DataFrame:
    """last / first - 1 inside [start, end] (dates as 'yyyy-MM-dd')."""
    p = prices.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    g = p.groupBy(key).agg(F.min_by(value, date).alias("first_close"), F.max_by(value, date).alias("last_close"))
    return g.withColumn("period_return", X.r6(F.col("last_close") / F.col("first_close") - 1))


# ---- fixed values: HTML entities decoded after tags are removed (&amp; last) ----
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def without_tables(html: Column) -> Column:
    """Text outside of all ``<table>`` elements, however deeply they are nested: the text is cut before each
    opening and after each closing tag, and a running depth says which pieces lie outside."""
    pieces = F.split(html, r"(?i)(?=<table\b)|(?<=</table>)")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc, piece):
        low = F.lower(piece)
        opened = acc["depth"] + F.when(low.rlike(r"^<table\b"), 1).otherwise(0)
        closed = F.greatest(opened - F.when(low.endswith("</table>"), 1).otherwise(0), F.lit(0))
        return F.struct(closed.alias("depth"), F.when(opened == 0, F.concat(acc["out"], piece)).otherwise(
            F.when(closed == 0, F.concat(acc["out"], F.lit(" "))).otherwise(acc["out"])).alias("out"))

    return F.when(html.rlike(r"(?i)<table\b"), F.aggregate(pieces, start, step)["out"]).otherwise(html)


def decode_numbers(text: Column) -> Column:
    """Numeric character references (decimal and hexadecimal) as the characters that they name."""
    parts = F.split(text, "&#")

    def one(p):
        ref = F.regexp_extract(p, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        hexa = F.lower(F.substring(ref, 1, 1)) == "x"
        code = F.when(hexa, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        fits = (ref != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(fits, F.concat(char, F.substring(p, F.length(ref) + 2, F.length(p)))).otherwise(F.concat(F.lit("&#"), p))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one)
    return F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, 0), F.array_join(rest, ""))).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: drop tables, then script/style blocks, comments, all tags; decode entities;
    collapse whitespace. Scripts go before tags because script bodies may contain tag-like text."""
    t = without_tables(html)
    t = F.regexp_replace(t, r"(?is)<script\b.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ent, ch in HTML_ENTITIES[:-1]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = decode_numbers(t)
    t = F.replace(t, F.lit(HTML_ENTITIES[-1][0]), F.lit(HTML_ENTITIES[-1][1]))
    return X.collapse_space(t)
