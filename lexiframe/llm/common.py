"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table_dir, write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of steps that are over when the driver collects them as garbage; have it do
    so now, and at most one step's files are on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: later jobs start from the
    files (a lost executor costs nothing) and the planner knows the table's true size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(write_table(df, name, **options))


_sent: set[str] = set()


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose function may use this package on any worker: the package goes along as a zip, once
    for each application, as with ``--py-files``."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _sent:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="lexiframe-"), "lexiframe.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(package):
                for n in (n for n in names if n.endswith(".py")):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(package)))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors can reach."""
    return table_dir(spark, name)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def shared_slots(slots: DataFrame) -> DataFrame:
    """Bitmap of the values of column ``slot`` (positive longs) that occur more than once, as rows
    (``bucket``, ``bits``) of 32,768 bits each: at most largest slot / 32,768 rows of 4 KB."""
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return bitmap_of(twice)


def bitmap_of(slots: DataFrame) -> DataFrame:
    """Bitmap rows (``bucket``, ``bits``) of the values of column ``slot`` (positive longs)."""
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))


def bit_is_set(bits: str, slot: str) -> Column:
    """Whether the bitmap row ``bits`` that belongs to ``slot`` has its bit; null bits: no."""
    return F.expr(
        f"coalesce((cast(conv(hex(substring({bits}, cast(bitmap_bit_position({slot}) div 8 as int) + 1, 1)), 16, 10) as int)"
        f" & shiftleft(1, cast(bitmap_bit_position({slot}) % 8 as int))) != 0, false)")


def with_hit(df: DataFrame, keys: list[str], others: DataFrame, slots: int = 1 << 23) -> DataFrame:
    """``df`` with a boolean ``__hit``: false only if its ``keys`` are no row of ``others`` (the same columns, by
    position). Told by a broadcast bitmap of ``slots`` bits, so that only likely partners of a join shuffle."""
    def slot(names):
        return F.pmod(F.xxhash64(*names), F.lit(slots)) + 1

    bits = stored(bitmap_of(others.select(slot(others.columns).alias("slot")).distinct()), "likely")
    bits = F.broadcast(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    marked = df.withColumn("__slot", slot(keys))
    return marked.join(bits, F.expr("bitmap_bucket_number(__slot)") == F.col("__bucket"), "left").withColumn(
        "__hit", bit_is_set("__bits", "__slot")).drop("__slot", "__bucket", "__bits")


def without(df: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are no row of ``gone`` (the same columns, by position; nulls are equal)."""
    gone = stored(gone.toDF(*[f"__g{i}" for i in range(len(keys))]).distinct(), "gone")
    marked = with_hit(df, keys, gone)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    return marked.where(~F.col("__hit")).unionByName(marked.where("__hit").join(gone, same, "left_anti")).drop("__hit")


def hash_sample(df: DataFrame, hash_col: str, n: int) -> DataFrame:
    """About ``n`` rows at most, those of the smallest values of a 64-bit hash column; all, if there are no more
    than ``n``. One count, and no sort, so nothing gathers that grows with the table."""
    total = df.select(hash_col).count()
    if total <= n:
        return df
    top = int(-(1 << 63) + (1 << 64) * (0.9 * n / total))
    return df.where(F.col(hash_col) < F.lit(top)).limit(n)
