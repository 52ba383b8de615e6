"""Model jobs on MLlib and the exact metric tables around them.

Metric tables (confusion, class report, fold summary, RMSE) are plain aggregations over a
prediction table, so they are exact and SQL-checkable. Fitting uses MLlib estimators; vectors
stay sparse (never densified)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

TOKEN_RX = r"[\p{L}\p{N}_]{2,}"


def class_report(ev: DataFrame, label: str, pred: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """precision / recall / F1 / support per class from one pass of conditional counts."""
    aggs = []
    for c in classes:
        aggs += [
            F.sum(((F.col(pred) == c) & (F.col(label) == c)).cast("int")).alias(f"tp{c}"),
            F.sum((F.col(pred) == c).cast("int")).alias(f"pn{c}"),
            F.sum((F.col(label) == c).cast("int")).alias(f"sp{c}"),
        ]
    row = ev.agg(*aggs)
    parts = [
        row.select(F.lit(c).alias("cls"),
                   X.r6(X.safe_div(F.col(f"tp{c}"), F.col(f"pn{c}"))).alias("precision"),
                   X.r6(X.safe_div(F.col(f"tp{c}"), F.col(f"sp{c}"))).alias("recall"),
                   X.r6(X.safe_div(2 * F.col(f"tp{c}"), F.col(f"pn{c}") + F.col(f"sp{c}"))).alias("f1"),
                   F.coalesce(F.col(f"sp{c}"), F.lit(0)).cast("bigint").alias("support"))
        for c in classes
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_summary(per_fold: DataFrame, score: str) -> DataFrame:
    """Mean and population standard deviation (numpy's default) of per-fold scores."""
    return per_fold.agg(X.r6(F.avg(score)).alias("mean_score"), X.r6(F.stddev_pop(score)).alias("std_score"),
                        F.count(F.lit(1)).alias("n_folds"))


def rmse_mse(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    err = F.pow(F.col(label) - F.col(prediction), 2)
    return pred.agg(X.r6(F.avg(err)).alias("mse"), X.r6(F.sqrt(F.avg(err))).alias("rmse"),
                    F.count(F.lit(1)).alias("n"))


def doc_tokens(text_col: str = "text"):
    """Library-default tokens: lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({TOKEN_RX})"), 1)


def uni_bi_grams(tokens):
    """Callers pass a materialised token column so the n-gram zip does not re-tokenise."""
    from ..functions.text import ngrams
    return F.concat(tokens, ngrams(tokens, 2))


def document_frequency_from_tf(tf: DataFrame) -> DataFrame:
    """(term, df): a (id, term, tf) table has one row per document and term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df_table: DataFrame, n_docs: int, min_df: float, max_df: float) -> DataFrame:
    """Terms with ``min_df * n <= df <= max_df * n`` (proportions of documents)."""
    return df_table.filter((F.col("df") >= F.lit(min_df * n_docs)) & (F.col("df") <= F.lit(max_df * n_docs)))


def by_document(docs: DataFrame, id_col: str, n_docs: int, per_task: int = 4000) -> DataFrame:
    """Texts exchanged once by document, in tasks of about ``per_task`` of them. Whatever is counted or summed by document
    after that stays in its task; the long table of terms, many times larger than the texts, is neither moved nor written."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // per_task)), id_col)


def term_counts(docs: DataFrame, id_col: str, grams_col: str, known: DataFrame | None = None) -> DataFrame:
    """(id, term, tf): raw n-gram counts per document, of the terms of the table ``known`` if one is given; no exchange if
    ``docs`` are ``by_document`` and ``known`` is broadcast."""
    # an outer explode: of another, Spark infers a filter on the array's size and makes all n-grams for it, where it reads
    terms = docs.select(id_col, F.explode_outer(grams_col).alias("term")).where(F.col("term").isNotNull())
    if known is not None:
        terms = terms.join(known, "term", "left_semi").select(id_col, "term")
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_long(tf: DataFrame, id_col: str, vocab: DataFrame, n_docs: int, rounded: bool = True) -> DataFrame:
    """(id, term, weight): raw count x smooth idf ``ln((1+n)/(1+df)) + 1``, L2-normalised per
    document. ``tf`` is the (id, term, tf) table, also the source of the document frequencies. With a least share of
    documents per term, a vocabulary has at most (terms of a document / share) rows and can be broadcast."""
    idf = vocab.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = tf.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))  # one document's terms
    weight = F.col("w") / norm
    return w.select(id_col, "term", (X.r6(weight) if rounded else weight).alias("weight"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """class weight ``n / (k * n_c)`` as a per-row column (k classes present)."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))  # one row per class
    every = Window.partitionBy()
    weights = per_class.select(label, (F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c"))).alias("weight"))
    return df.join(weights, label)


def stratified_split(df: DataFrame, label: str, order_col: str, test_share: float, seed: int | None = 42) -> DataFrame:
    """Adds ``is_test``: within every class, rows ordered by a seeded hash of the id (or by the id
    itself when ``seed`` is None); the first ``round(test_share * n_c)`` are test. Ranks come from
    the range-partitioned ``row_index``, so a dominant class spans many tasks."""
    from .corpus import row_index
    key = F.xxhash64(F.col(order_col), F.lit(seed)) if seed is not None else F.col(order_col)
    ranked = row_index(df.withColumn("_key", key), ["_key", order_col], name="_rk", with_total=True,
                       partition_cols=[label])
    return ranked.withColumn("is_test", (F.col("_rk") < F.round(F.col("_total") * test_share)).cast("int")).drop(
        "_key", "_rk", "_total")


def stratified_folds(df: DataFrame, label: str, order_col: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1, dealt in turn within every class in the order of a seeded hash of the id."""
    from .corpus import row_index
    ranked = row_index(df.withColumn("_key", F.xxhash64(F.col(order_col), F.lit(seed))), ["_key", order_col], name="_rk", partition_cols=[label])
    return ranked.withColumn("fold", (F.col("_rk") % k).cast("int")).drop("_key", "_rk")


def ranked(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` with its rows' places from 0 in an order; for bounded tables (a selection, a list of trials)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
