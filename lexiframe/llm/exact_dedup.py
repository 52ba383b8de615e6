"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only built-in functions run here. Whether a length (then a length and prefix) is shared by several rows is
kept in a bitmap of ``slots`` bits, whose size is bounded by that parameter whatever the corpus, so it can be
broadcast and texts never move for the refinement. Two values that meet in one slot only let a row through
to the next, finer test. The full text is hashed for rows that pass both tests; only 100-byte rows shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_is_set, shared_slots, stored, table, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space is one space."""
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
                prefix_chars: int = 256, slots: int = 1 << 26, hot: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, ``carry`` columns, ``keep_id``, ``group_size``, ``kept``.

    ``keep_id`` is the smallest id among rows of equal normalised text, ``kept`` says that the row has it.
    Null text is the empty text, and all empty texts are one group. Rows that repeat an id with the same text
    are counted each and share one decision. A null id never becomes ``keep_id`` unless its group has no other,
    and then the row is kept. An empty table gives an empty result. ``slots`` bounds each broadcast bitmap
    (bits; 2**26 are at most 2,048 rows of 4 KB), ``hot`` the rows of the broadcast table of large groups.
    """
    norm = normalised(F.col(text_col))
    length = F.length(norm).cast("long")
    len_slot = length % slots + 1

    by_length = F.broadcast(_renamed(stored(shared_slots(docs.select(len_slot.alias("slot"))), "dedup-lengths"), "l"))
    keyed = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)],
                        norm.alias("__norm"), length.alias("__len"), len_slot.alias("__lslot"))
    first = keyed.join(by_length, F.expr("bitmap_bucket_number(__lslot)") == F.col("__lbucket"), "left").withColumn(
        "__same_len", bit_is_set("__lbits", "__lslot")).drop("__lbucket", "__lbits")
    second = first.withColumn("__pslot", F.when(
        F.col("__same_len"), F.pmod(F.xxhash64("__len", F.substring("__norm", 1, prefix_chars)), F.lit(slots)) + 1))
    by_prefix = F.broadcast(_renamed(stored(
        shared_slots(second.where("__same_len").select(F.col("__pslot").alias("slot"))), "dedup-prefixes"), "p"))
    third = second.join(by_prefix, F.expr("bitmap_bucket_number(__pslot)") == F.col("__pbucket"), "left").withColumn(
        "__survives", F.col("__same_len") & bit_is_set("__pbits", "__pslot"))
    # Rows that passed neither test are alone: their key is one that nobody shares, not a common null.
    full = third.select(
        "__id", *[f"__c{i}" for i in range(len(carry))], "__survives",
        F.when(F.col("__survives"), F.sha2("__norm", 256))
        .otherwise(F.concat_ws("-", F.lit("alone"), F.col("__len"), F.xxhash64("__norm"))).alias("__key"))
    groups = stored(full.where("__survives").groupBy("__key")
                    .agg(F.min("__id").alias("__keep"), F.count("*").alias("__n")).where("__n > 1"), "dedup-groups")
    # Groups of a ``hot``-th of all copies or more, ``hot`` of them at most, are broadcast; their rows, which would meet
    # in one task, go to the join of the others under keys that match nothing.
    copies = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("__n") * hot >= copies
    heavy = groups.where(is_hot).select(
        F.col("__key").alias("__hkey"), F.col("__keep").alias("__hkeep"), F.col("__n").alias("__hn"))
    light = groups.where(~is_hot).withColumnRenamed("__key", "__gkey")
    full = full.join(F.broadcast(heavy), F.col("__key") == F.col("__hkey"), "left").withColumn(
        "__key", F.when(F.col("__hkey").isNull(), F.col("__key")).otherwise(
            F.concat_ws("-", F.lit("hot"), F.xxhash64("__id"), F.spark_partition_id())))
    out = full.join(light, F.col("__key") == F.col("__gkey"), "left").withColumn(
        "__keep", F.when(F.col("__hkey").isNull(), F.col("__keep")).otherwise(F.col("__hkeep"))).withColumn(
        "__n", F.coalesce("__hn", "__n"))
    keep = F.coalesce("__keep", "__id")
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
                      keep.alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("__id").eqNullSafe(keep).alias("kept"))


def _renamed(bitmap: DataFrame, p: str) -> DataFrame:
    return bitmap.select(F.col("bucket").alias(f"__{p}bucket"), F.col("bits").alias(f"__{p}bits"))


def op4_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=["text_sha256"])


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256 AS h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.text_sha256 = g.h
"""

QUERIES = {"op4_exact_dedup": (op4_exact_dedup, SQL)}
