"""Table sources and sinks: schema'd reads, multi-part reads, wide->long dimensions, writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None,
               **options) -> DataFrame:
    """Read a delimited / parquet / json table with an explicit schema (no inference pass)."""
    fmt = fmt or ("csv" if path.endswith((".csv", ".tsv", ".txt")) else "json" if path.endswith(".json") else "parquet")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        options.setdefault("header", "true")
    return r.options(**options).load(path)


def read_parts(spark: SparkSession, parts: Sequence[tuple[int, str, str]], text_col: str = "text") -> DataFrame:
    """Stack numbered part files (part number, path, id column) into one (part, id, text) table."""
    out = None
    for part, path, id_col in parts:
        df = spark.read.parquet(path).select(F.lit(part).alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def wide_to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name_col: str, value_col: str) -> DataFrame:
    """Dimension columns -> long (id..., category, term), missing terms dropped."""
    sel = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return sel.unpivot(list(ids), list(cols), name_col, value_col).dropna(subset=[value_col])


def table_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: a lineage cut that survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                path: str | None = None, **options) -> str:
    """Write (overwrite) and return the path; parents are created by the writer."""
    path = path or table_dir(df.sparkSession, name)
    w = df.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
