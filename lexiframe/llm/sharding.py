"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group and stay in one shard. Groups are the items to pack; those below one
``units_per_shard``-th of a shard in each dimension are first bundled by a hash of their text, so the packer sees at
most a few ``units_per_shard`` x shards items however large the corpus. A group is cut into pieces only if it exceeds
a shard in some dimension, or if shards cannot be made equal to ``near`` without it: then the groups above a quarter
of a shard are cut, and so on down to ``split_above``.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (row of ``vectors``): largest items first, each where the dot product of its
    vector with the shard's residual capacity is highest; ties go to the lowest shard number."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total / n_shards, 1.0)
    residual = np.ones((n_shards, vectors.shape[1]))
    shard = np.zeros(len(vectors), dtype=np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        s = int(np.argmax(residual @ share[i]))
        residual[s] -= share[i]
        shard[i] = s
    return shard


def place_groups(vectors: np.ndarray, group: np.ndarray, n_shards: int, near: float, split_above: float) -> np.ndarray:
    """Shard of each item. Consecutive items of one ``group`` number are the pieces that it may be cut into, and stay
    together but for the fewest groups whose cutting leaves every shard within ``near`` of the mean in each dimension;
    if that cannot be had, groups above ``split_above`` of a shard are cut."""
    if not len(vectors):
        return np.empty(0, dtype=np.int32)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    fine = np.diff(np.append(starts, len(group)))
    mean = vectors.sum(axis=0) / n_shards
    share = (np.add.reduceat(vectors, starts) / np.where(mean > 0, mean, 1.0)).max(axis=1)
    nth = np.arange(len(group)) - np.repeat(starts, fine)
    limit = 1.0
    while True:
        pieces = np.where(share > limit, np.minimum(fine, np.ceil(4 * share / limit)), 1).astype(np.int64)
        first = np.cumsum(pieces) - pieces
        block = np.repeat(first, fine) + nth * np.repeat(pieces, fine) // np.repeat(fine, fine)
        parts = np.add.reduceat(vectors, np.flatnonzero(np.append(True, block[1:] != block[:-1])))
        shard = place(parts, n_shards)
        load = np.stack([np.bincount(shard, weights=x, minlength=n_shards) for x in parts.T], axis=1)
        if limit <= split_above or (np.abs(load - mean) <= near * mean).all():
            return shard[block]
        limit = max(limit / 4, split_above)


def pack(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
         units_per_shard: int = 2048, near: float = 0.005, split_above: float = 1 / 32, buckets: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard``, ``slot``.

    Bytes, tokens (runs of other than ASCII white space) and rows are near equal across shards. Slots count
    from 0 in each shard without gaps. Null text has size 1, no token and crc 0, and null texts are a group of
    their own; empty text likewise. Rows that repeat an id, or have none, are rows of their own. An empty table gives no
    rows. ``near`` and ``split_above`` decide which groups of equal texts are cut (``place_groups``).
    The driver sees three totals and at most 4 x ``units_per_shard`` x ``n_shards`` item vectors.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"),
        F.expr(f"cast(regexp_count(coalesce(`{text_col}`, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') as long)").alias("tokens"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("gkey"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")  # written, so a row keeps its number
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    share = F.greatest(*[F.col(c) * F.lit(n_shards / max(1, total[c] or 0)) for c in ("size", "tokens", "rows")])
    groups = stored(rows.groupBy("gkey").agg(*sums).where(share * units_per_shard >= 1).select(
        F.col("gkey").alias("hkey"), F.when(share > split_above, F.ceil(4 * share / F.lit(split_above)))
        .otherwise(F.lit(1)).cast("int").alias("fine")), "shard-heavy")  # units_per_shard x n_shards in each dimension
    cells = units_per_shard * n_shards
    united = rows.join(F.broadcast(groups), F.col("gkey") == F.col("hkey"), "left").withColumn("item", F.coalesce(
        "hkey", F.concat_ws(":", F.lit("cell"), F.pmod(F.xxhash64("gkey"), F.lit(cells)).cast("string")))
    ).withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("fine")).cast("int"), F.lit(0)))
    units = united.groupBy("item", "piece").agg(*sums).orderBy("item", "piece").toPandas()
    shard = place_groups(units[["size", "tokens", "rows"]].to_numpy(dtype=float),
                         units["item"].factorize()[0], n_shards, near, split_above)
    where = spark.createDataFrame([(u, int(q), int(s)) for u, q, s in zip(units["item"], units["piece"], shard)],
                                  "pitem string, ppiece int, shard int")
    placed = united.join(F.broadcast(where), (F.col("item") == F.col("pitem")) & (F.col("piece") == F.col("ppiece"))).select(
        "id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(buckets)).alias("bucket"))
    # A shard may hold any number of rows, so its slots are numbered bucket by bucket.
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most n_shards x buckets rows
    offsets = counts.select(
        F.col("shard").alias("oshard"), F.col("bucket").alias("obucket"),
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    numbered = placed.withColumn(
        "i", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")) - 1)
    return numbered.join(
        F.broadcast(offsets), (F.col("shard") == F.col("oshard")) & (F.col("bucket") == F.col("obucket"))
    ).select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
             (F.col("offset") + F.col("i")).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": (op8_sharding, None)}
