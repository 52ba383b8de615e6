"""Relational corpus operators: dedupe, global row index without a single-task window,
ntile batches, membership flags, first-match lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as TB


def dedupe_by(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key: the row with the smallest (``first``) or largest (``last``) order tuple.

    Expressed as ``min/max(struct(order..., rest...))`` per key, so the shuffle carries partial
    aggregates (map-side combine): a key holding a third of all rows costs one struct per map task
    instead of a window partition that has to be sorted in one task. Order columns must make rows
    unique (ties are then broken by the remaining columns, deterministically)."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    pick = F.min if keep == "first" else F.max
    if not rest and len(order_cols) == 1:  # fixed-width buffer: hash aggregate
        return df.groupBy(*keys).agg(pick(order_cols[0]).alias(order_cols[0]))
    packed = F.struct(*[F.col(c) for c in list(order_cols) + rest])
    return df.groupBy(*keys).agg(pick(packed).alias("_r")).select(*keys, "_r.*")


def row_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "row_idx",
              num_parts: int | None = None, with_total: bool = False,
              partition_cols: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position in ``order_cols`` order (unique), optionally restarting for every
    value of ``partition_cols``, computed without a single-task window: range-partition on
    (partition cols, order cols) and sort within partitions; count rows per (range partition, group)
    into a tiny table; running offsets over that table; position inside the partition block.
    A hot group simply spans several range partitions."""
    spark = df.sparkSession
    n = num_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(partition_cols) + list(order_cols)
    # Written once: counts and rows must come from one and the same range partitioning. Two exchanges of
    # differently pruned frames would sample their own bounds.
    ranged = TB.stored(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)),
        "row-index",
    )
    grp = list(partition_cols)
    blocks = ranged.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_start"))
    before = Window.partitionBy(*grp).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_pid", *grp, "_start",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*grp)).alias("_total"),
    )
    if not grp:  # one row per range partition: bounded by ``n``
        offsets = F.broadcast(offsets)
    out = ranged.join(offsets, ["_pid", *grp]).withColumn(name, F.col("_off") + F.col("_pos") - F.col("_start"))
    drop = ["_pid", "_pos", "_off", "_start"] + ([] if with_total else ["_total"])
    return out.drop(*drop)


def ntile_of(idx: str, total: str, n: int) -> Column:
    """SQL ``ntile(n)`` from a 0-based index and the row count (first ``total % n`` tiles one larger)."""
    return F.expr(
        f"""CASE WHEN {idx} < ({total} % {n}) * ({total} div {n} + 1)
                 THEN {idx} div ({total} div {n} + 1) + 1
                 ELSE ({total} % {n}) + ({idx} - ({total} % {n}) * ({total} div {n} + 1)) div ({total} div {n}) + 1
            END"""
    ).cast("int")


def member_flags(df: DataFrame, col: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``flag = 1`` if ``col`` is in the list (one left join per list; the planner sees the list's size)."""
    spark = df.sparkSession
    out = df
    for flag, items in lists.items():
        lst = spark.createDataFrame([(x,) for x in sorted(set(items))], "_m string")
        out = (out.join(lst, out[col] == lst["_m"], "left")
               .withColumn(flag, F.col("_m").isNotNull().cast("int")).drop("_m"))
    return out


def first_match_dim(dim: DataFrame, key: str, order_col: str) -> DataFrame:
    """Dimension made unique by key, first row (smallest ``order_col``) wins."""
    return dedupe_by(dim, [key], [order_col], keep="first")
