"""From raw documents to token ids: each stage works on all that the one before it kept.

toxicity -> exact duplicates -> near duplicates -> benchmark decontamination -> byte-pair encoding. All but the
last return rows of ``documents`` as they came; the last returns what ``op10`` does for the rows that are left.
Null and empty texts are ordinary rows: they are scored, all but one of a group of empty texts go, and they have
no shingles, words or tokens. Rows that repeat an id and text share one decision. Extra columns are carried along, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm.bpe import encode_documents, vocabulary_path
from lexiframe.llm.common import stored, table, without
from lexiframe.llm.decontaminate import decontaminate
from lexiframe.llm.exact_dedup import exact_dedup
from lexiframe.llm.near_dedup import near_dedup
from lexiframe.llm.toxicity import score, train


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "doc_id"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted not toxic; the labels that are not held out are learnt from."""
    model = train(docs, table(spark, sf_dir, "labels"))
    inner = docs.select("doc_id", *[F.col(c).alias(f"__d{i}") for i, c in enumerate(_others(docs))])
    of = dict(zip(_others(docs), inner.columns[1:]))
    kept = score(inner, model, text_col=of["text"], carry=list(of.values())).where(F.col("predicted") == 0)
    return kept.select(*[F.col(of.get(c, c)).alias(c) for c in docs.columns])


def _drop(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of an id and text hash in ``gone``; texts of few other rows move."""
    return without(docs.withColumn("__hash", F.xxhash64("text")), ["doc_id", "__hash"], gone).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id."""
    thin = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return _drop(docs, exact_dedup(thin, carry=["text_hash"]).where("not kept").select("doc_id", "text_hash"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (four fifths of their runs of five words or more) the document of the smallest id."""
    return _drop(docs, near_dedup(docs, percent=80, with_hash=True).where("not kept").select("doc_id", "text_hash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    return _drop(docs, found.where("contaminated").select("doc_id", "text_hash"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return encode_documents(docs, vocabulary_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: None: SQL cannot state the toxicity stage; ``tests/llm`` holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
