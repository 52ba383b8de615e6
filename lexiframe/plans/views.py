"""Role views: how the driver's tables stand in for the reference's inputs (articles, entities,
keystroke logs, filings, prices, answers). Every view is a lazy DataFrame over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog as C
from ..functions import text as X


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fixed(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of fixed values; size is bounded by the code, so it is safe to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def nations(spark, d) -> DataFrame:
    """Entity dimension: TPC-H nation/region are fixed-size (25 / 5 rows) and broadcast."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    stems = fixed(spark, enumerate(C.ENTITY_STEMS), "entity_key int, stem string")
    return F.broadcast(
        n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .join(stems, n.n_nationkey == stems.entity_key, "left")
        .select(
            n.n_nationkey.alias("entity_key"),
            n.n_name.alias("entity"),
            r.r_name.alias("region"),
            "stem",
        )
    )


def _article_keys(spark, d) -> DataFrame:
    """article_id, entity columns and date of each order: what is joined to the texts, and far smaller."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    ent = nations(spark, d)
    return orders.join(cust, orders.o_custkey == cust.c_custkey).join(ent, cust.c_nationkey == ent.entity_key).select(
        F.col("o_orderkey").alias("article_id"), "entity_key", "entity", "region", "stem", F.to_date("o_orderdate").alias("date"))


ARTICLE_COLS = ["article_id", "text", "lang", "publisher", "entity_key", "entity", "region", "stem", "date"]


def _with_texts(spark, d, keys: DataFrame) -> DataFrame:
    """Articles of a table of keys. The texts move once, in this join, which also spreads a scan of few splits over all
    cores; keys are joined among themselves before."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text", "lang", F.col("source").alias("publisher"))
    return docs.join(keys.hint("merge"), "article_id")


def articles(spark, d) -> DataFrame:
    """One row per article: documents joined to orders, customer, nation and region; nation/region are broadcast."""
    return _with_texts(spark, d, _article_keys(spark, d)).select(*ARTICLE_COLS)


def labelled_articles(spark, d) -> DataFrame:
    """Articles with their two annotations (null where there is none)."""
    labels = table(spark, d, "labels").select(
        F.col("doc_id").alias("article_id"), F.col("quality").alias("label"), F.col("toxic").alias("appointment"))
    return _with_texts(spark, d, _article_keys(spark, d).join(labels, "article_id", "left")).select(*ARTICLE_COLS, "label", "appointment")


def dated_articles(spark, d) -> DataFrame:
    """Articles whose text starts with a date header line, as the raw corpus files do."""
    a = articles(spark, d)
    return a.withColumn(
        "raw_text", F.concat(F.lit("Date: "), F.date_format("date", "dd.MM.yyyy"), F.lit("\n"), "text")
    )


def capitals(spark, d) -> DataFrame:
    """Capital stand-in: lowest-key supplier name per nation (a per-nation min, map-side combined)."""
    s = table(spark, d, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("entity_key")).agg(
        F.min_by("s_name", "s_suppkey").alias("capital")
    )


def region_capitals(spark) -> DataFrame:
    return fixed(spark, C.REGION_CAPITALS, "region string, capital_term string")


def lexicon(spark) -> DataFrame:
    return fixed(spark, C.LEXICON, "category string, term string")


def keystroke_events(spark, d) -> DataFrame:
    """Keystroke-log stand-in from ``events``: writer = user_id, down = ts, up = ts + value seconds."""
    e = table(spark, d, "events")
    act = fixed(spark, C.ACTIVITY_BY_EVENT, "event_type string, base_activity string")
    k = F.get_json_object("props", "$.k").cast("int")
    down = F.floor(X.epoch_micros(F.col("ts")) / 1000).cast("bigint")
    up = down + F.round(F.col("value") * 1000).cast("bigint")
    activity = (
        F.when((F.col("event_type") == "error") & (k % 2 == 0),
               F.format_string("Move From [%d, %d] To [%d, %d]", k, k + 2, k + 3, k + 5))
        .otherwise(F.col("base_activity"))
    )
    return (
        e.join(act, "event_type", "left")
        .select(
            F.col("user_id").alias("id"),
            "event_id",
            down.alias("down_time"),
            up.alias("up_time"),
            (up - down).alias("action_time"),
            activity.alias("activity"),
            F.repeat(F.lit("q"), k % 5 + 1).alias("text_change"),
            k.alias("cursor_position"),
        )
    )


def prices(spark, d) -> DataFrame:
    """Daily close per ticker: ticker = l_partkey, close = max unit price of that part that day."""
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("date")
    ).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def facts(spark, d) -> DataFrame:
    """Flat filing facts: company = o_custkey, report = order, fact by return flag, unit by status."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    fact = fixed(spark, C.FACT_BY_FLAG, "l_returnflag string, fact string")
    unit = fixed(spark, C.UNIT_BY_STATUS, "l_linestatus string, unit string")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(fact, "l_returnflag")
        .join(unit, "l_linestatus")
        .select(
            F.col("o_custkey").alias("company"),
            "fact",
            "unit",
            F.to_date("l_shipdate").alias("end"),
            F.col("l_extendedprice").alias("val"),
            X.pad_id("l_orderkey").alias("accn"),
            F.year("o_orderdate").alias("fy"),
            F.col("o_orderpriority").alias("form"),
            F.when(F.col("l_linestatus") == "F", F.concat(F.lit("CY"), F.year("l_shipdate").cast("string")))
            .alias("frame"),
            "l_orderkey",
            "l_linenumber",
        )
    )


EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
