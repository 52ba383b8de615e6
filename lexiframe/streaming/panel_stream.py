"""Incremental panel counts: the batch panel plan fed by ``readStream``.

The reference has no streaming; the panel jobs avoid actions so the same plan can run on a file
stream of new documents. New article files are joined (stream-static) to the order / customer /
nation dimensions and counted per (year, quarter, entity); each micro-batch's partial counts are
a partition of their own, and the panel is their sum (a ``complete``-mode aggregate would keep all keys in state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views as V


def article_stream(spark: SparkSession, docs_dir: str, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(docs_dir)
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = V.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    ent = V.nations(spark, d)
    return (docs.join(orders, docs.doc_id == orders.o_orderkey)
            .join(cust, orders.o_custkey == cust.c_custkey)
            .join(ent, cust.c_nationkey == ent.entity_key)
            .select("doc_id", "entity", F.to_date("o_orderdate").alias("date")))


def start_panel_counts(spark: SparkSession, docs_dir: str, d: str, out_dir: str, checkpoint_dir: str):
    """Start the stream; every micro-batch appends its (year, quarter, entity, n) partial counts."""
    arts = article_stream(spark, docs_dir, d)

    def write_batch(batch: DataFrame, epoch: int):
        part = batch.groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter"), "entity").agg(
            F.count(F.lit(1)).alias("n")).withColumn("epoch", F.lit(epoch))
        # a batch that is tried again replaces its own partition
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_dir)

    return arts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir).start()


def read_panel(spark: SparkSession, out_dir: str) -> DataFrame:
    """Panel = sum of the appended partial counts."""
    return spark.read.parquet(out_dir).groupBy("year", "quarter", "entity").agg(F.sum("n").alias("total_articles"))
