"""Articles about a namesake: a table of rules (rule, stem, context, surname, gap) says that a text in which the word
``context`` is followed within ``gap`` words by a word that begins with ``surname`` is not about the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables as TB


def matches(articles: DataFrame, rules: DataFrame, id_col: str = "article_id", text_col: str = "text", stem_col: str = "stem",
            broadcast_rules: int = 50_000) -> DataFrame:
    """(id, rule), distinct. A rule with a ``stem`` is tried on articles of that entity stem, one without on all.

    One join takes every word, and its beginnings of the lengths that surnames have, to the rules that name it; what is
    left are the places of context words and surnames, and per article and rule the last context word before each
    surname decides. Up to ``broadcast_rules`` rules (counted) are broadcast, more are joined by their words. Case does
    not count; null texts and rules without context or surname match nothing."""
    rules = rules.where("context IS NOT NULL AND context <> '' AND surname IS NOT NULL AND surname <> ''")
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("surname")).alias("lengths")).first()
    sought = rules.select("rule", F.col("stem").alias("of"), "gap", F.explode(F.array(
        F.struct(F.lit("c").alias("kind"), F.lower("context").alias("key")),
        F.struct(F.lit("s").alias("kind"), F.lower("surname").alias("key")))).alias("k")).select("rule", "of", "gap", "k.*").distinct()
    if shape["n"] <= broadcast_rules:
        sought = F.broadcast(sought)
    words = articles.select(F.col(id_col).alias("id"), F.col(stem_col).alias("stem"),
                            F.posexplode(F.regexp_extract_all(text_col, F.lit(f"({X.WORD}+)"), 1)).alias("pos", "w")).withColumn("w", F.lower("w"))
    keys = [F.struct(F.lit("c").alias("kind"), F.col("w").alias("key"))] + [
        F.when(F.length("w") >= n, F.struct(F.lit("s").alias("kind"), F.left("w", F.lit(n)).alias("key"))) for n in sorted(shape["lengths"])]
    places = words.select("id", "stem", "pos", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("id", "stem", "pos", "k.*")
    found = places.join(sought, ["kind", "key"]).where("of IS NULL OR of = stem")
    before = Window.partitionBy("id", "rule").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("kind") == "c", F.col("pos"))).over(before)
    return found.withColumn("last", last).where("kind = 's' AND pos - last <= gap").select(F.col("id").alias(id_col), "rule").distinct()


def split(articles: DataFrame, rules: DataFrame, id_col: str = "article_id", **options) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the articles without a match, and those with one and their ``rules``, sorted. The matches are
    written once, so both sides tell the same."""
    hit = TB.stored(matches(articles, rules, id_col, **options).groupBy(id_col).agg(F.sort_array(F.collect_list("rule")).alias("rules")), "namesakes")
    return articles.join(hit, id_col, "left_anti"), articles.join(hit, id_col)
