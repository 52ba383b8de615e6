"""Panels: entity x period roll-ups, month spines from tenures, gap-filled monthly counts,
density histograms. Aggregations are hash aggregates with map-side partial aggregation, so a hot
entity costs one partial row per map task; spines are generated per entity (no cross join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus as CO
from ..functions import text as X
from ..plans import views as V

PERIODS = {"quarter": F.quarter, "month": F.month}


def tenure(spark, d) -> DataFrame:
    """Entity tenure (entry and end date) derived from the nation key by a fixed rule."""
    n = V.table(spark, d, "nation")
    base = F.lit("1995-01-01").cast("date")
    return F.broadcast(n.select(
        F.col("n_name").alias("entity"),
        F.date_add(base, (F.col("n_nationkey") * 61).cast("int")).alias("entry_date"),
        F.date_add(base, (F.col("n_nationkey") * 61 + 700 + F.col("n_nationkey") * 37).cast("int")).alias("end_date"),
    ))


def month_spine(ten: DataFrame) -> DataFrame:
    """(entity, month): every calendar month touched by the tenure, anchored on the 1st so that
    month arithmetic never keeps a day 29-31."""
    months = F.sequence(F.trunc("entry_date", "MM"), F.trunc("end_date", "MM"), F.expr("INTERVAL 1 MONTH"))
    return ten.select("entity", F.explode(months).alias("month"))


def tenure_spine(spark, d) -> DataFrame:
    return month_spine(tenure(spark, d))


def month_index(month: Column) -> Column:
    """Months since 2000-01 (0-based)."""
    return (F.year(month) - 2000) * 12 + F.month(month) - 1


def panel(df: DataFrame, period: str, measures: Sequence[str], entity: str = "entity", date: str = "date",
          source_filter: Column | None = None) -> DataFrame:
    """(year, quarter|month, entity) -> total_articles + sum of every measure column, in that order; sums of whole
    numbers are longs, others are rounded to six places."""
    if source_filter is not None:
        df = df.filter(source_filter)
    types = dict(df.dtypes)
    keys = [F.year(date).alias("year"), PERIODS[period](date).alias(period), F.col(entity)]
    aggs = [F.count(F.lit(1)).alias("total_articles")] + [
        (X.r6(F.sum(m)) if types[m] in ("double", "float") else F.sum(m).cast("bigint")).alias(m) for m in measures]
    return df.groupBy(*keys).agg(*aggs).orderBy("year", period, entity)


def density_histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bucket, lo, hi, n, density) with ``density = n / (N * width)``; the maximum goes into the
    last bucket. The global min/max/count is one tree-reduced aggregate row of three scalars, read
    on the driver and used as literals (no join back)."""
    st = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"),
                F.count(col).alias("n")).first()
    mn, mx, n_all = st["mn"], st["mx"], st["n"]
    if not n_all:
        return df.sparkSession.createDataFrame([], "bucket int, lo double, hi double, n bigint, density double")
    width = (mx - mn) / bins if mx > mn else 1.0
    bucket = F.least(F.floor((F.col(col) - F.lit(mn)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    out = df.filter(F.col(col).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        "bucket",
        X.r6(F.lit(mn) + (F.col("bucket") - 1) * F.lit(width)).alias("lo"),
        X.r6(F.lit(mn) + F.col("bucket") * F.lit(width)).alias("hi"),
        "n",
        X.r6(F.col("n") / F.lit(n_all * width)).alias("density"),
    )


def gap_filled_counts(spine: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spine left-joined to counts of events per key; absent cells are 0."""
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return spine.join(counts, list(keys), "left").withColumn("hits", F.coalesce("_c", F.lit(0))).drop("_c")

