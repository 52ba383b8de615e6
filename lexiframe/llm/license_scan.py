"""License detection with ordered signature rules (``license_rules``), in built-in functions only.

A text that holds none of the rules' stems is done with one pass of plain substring tests. In the others each word is
written with its place (" word:place "), a rule is tried if all its plain words are there, and each match tells by
itself where it begins and ends, in words. Of overlapping detections one that lies inside another is suppressed if the
other's kind is at least as strong: detections are sorted by start, and the furthest end that each kind reached before
tells whether one is covered. No two detections are compared in pairs.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty
from .license_rules import ANCHORS, WEIGHT, anchor, compiled, required, rules

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
RULE = "rule int, kind int, label string, base boolean, weight double, rx string, keys array<string>"


def rule_table(listed: list[dict]) -> Column:
    """The rules as one constant: an expression over tagged text and the substrings that it cannot do without."""
    rows = [{**{k: r[k] for k in ("rule", "kind", "label", "base", "weight")}, "rx": compiled(r["words"]),
             "keys": [f" {w}:" for w in required(r["words"])] + [anchor(r["words"])]} for r in listed]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")


def tagged(words: Column) -> Column:
    """" word:place " for each word; two spaces stand between words, so matches that follow each other share none."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit(":"), i)), "  "), F.lit(" "))


def _found(listed: Column, text: str) -> Column:
    """All matches of the rules whose keys are in the text: start and end (exclusive) in words, and the rule."""
    def one(r):
        def at(m):
            first = F.substring_index(F.substring_index(F.substring_index(m, ":", 2), ":", -1), " ", 1)
            last = F.trim(F.substring_index(m, ":", -1))
            return F.struct(first.cast("long").alias("start"), (last.cast("long") + 1).alias("end"), r["kind"].alias("kind"), r["rule"].alias("rule"),
                            r["label"].alias("label"), r["base"].alias("base"), r["weight"].alias("weight"))
        return F.transform(F.regexp_extract_all(F.col(text), r["rx"], F.lit(0)), at)
    tried = F.filter(listed, lambda r: F.forall(r["keys"], lambda k: F.contains(F.col(text), k)))
    return F.flatten(F.transform(tried, one))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: list[dict] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base`` (places of the base phrases), ``first_word``,
    ``last_word`` (their smallest and largest start; null if none), ``base_labels``, ``labels`` (of base phrases and of
    detections that nothing suppresses; sorted, comma-joined), ``score`` (the weight of the surest, 0 if none) and
    ``spans`` (detections left: start, end in words, label). ``listed``: rules in the form of ``license_rules.rules``.

    A null text is empty, and has no words and no labels. Rows that repeat an id and text give a row each, null ids
    too. Texts of any length are scanned whole; no other column is read. An empty table gives no rows. Of detections
    at the same place and of the same kind the first rule's stays.
    """
    listed = rules() if listed is None else listed
    stems = sorted({anchor(r["words"]) for r in listed}, key=ANCHORS.index)
    text = text_or_empty(F.col(text_col))
    maybe = F.exists(F.array(F.lower(text)),  # an array of one, so that the text is lower-cased once for all stems
                     lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in stems], F.lit(False)))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), maybe.alias("__maybe"))
    words = F.regexp_extract_all(F.translate("__text", CAPITALS, SMALL), F.lit(WORD), F.lit(0))
    # one pass over the texts; what few of them are worth a closer look is written with places
    rows = stored(rows.select("__id", F.regexp_count("__text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.spark_partition_id().alias("__salt"),
                              F.when(F.col("__maybe"), F.sha2("__text", 256)).alias("__key"), F.when(F.col("__maybe"), tagged(words)).alias("__tagged")), "licenses")
    spans = "array<struct<start:bigint,end:bigint,label:string>>"
    none = rows.where("__key is null").select(
        F.col("__id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"),
        F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.array().cast(spans).alias("spans"))
    hits = rows.where("__key is not null").select("__id", "__key", "__salt", "n_words", F.inline_outer(_found(rule_table(listed), "__tagged")))
    # rows that repeat are one group with a count; the part of the scan in the key keeps any group to one part's rows
    row = ["__id", "__key", "__salt"]
    hits = hits.groupBy(hits.columns).agg(F.count("*").alias("copies"))
    before = Window.partitionBy(row).orderBy("start", F.desc("end"), "kind", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reached = [F.max(F.when(F.col("kind") <= k, F.col("end"))).over(before) for k in WEIGHT]
    covered = F.coalesce(F.element_at(F.array(*reached), F.col("kind") + 1) >= F.col("end"), F.lit(False))
    hits = hits.withColumn("left", F.col("rule").isNotNull() & ~covered)
    base, counts = F.coalesce("base", F.lit(False)), F.col("left") | F.coalesce("base", F.lit(False))
    per = hits.groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(counts, F.col("weight"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("left"), F.struct("start", "end", "label")))).alias("spans"))
    every = per.select(F.col("__id").alias(id_col), *none.columns[1:], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"))
    return none.unionByName(every.drop("__copy"))


def op11_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def sql(listed: list[dict]) -> str:
    def text(s):
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({r['rule']}, {r['kind']}, {text(r['label'])}, {r['base']}, {r['weight']}::DOUBLE, {text(compiled(r['words']))})" for r in listed)
    return rf"""
WITH rules(rule, kind, label, base, weight, rx) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}') AS w FROM documents
), t AS (
  SELECT k, ' ' || array_to_string(list_transform(w, lambda x, i: x || ':' || (i - 1)), '  ') || ' ' AS t FROM d
  WHERE list_has_any(list_transform(w, lambda x: regexp_matches(x, '{"|".join(ANCHORS)}')), [true])
), m AS (
  SELECT k, rule, kind, label, base, weight, unnest(regexp_extract_all(t, rx, 0)) AS m FROM t CROSS JOIN rules
), s AS (
  SELECT k, rule, kind, label, base, weight, CAST(regexp_extract(m, ':([0-9]+) ', 1) AS BIGINT) AS s,
         CAST(regexp_extract(m, ':([0-9]+) $', 1) AS BIGINT) + 1 AS e FROM m
), l AS (
  SELECT *, base OR NOT EXISTS (
    SELECT 1 FROM s o WHERE o.k = s.k AND o.s <= s.s AND o.e >= s.e AND o.kind <= s.kind AND o.rule <> s.rule
      AND (o.s < s.s OR o.e > s.e OR o.kind < s.kind OR o.rule < s.rule)) AS counts
  FROM s
), g AS (
  SELECT k, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts) AS labels, max(weight) FILTER (counts) AS score
  FROM l GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN g USING (k)
"""


QUERIES = {"op11_license_scan": (op11_license_scan, sql(rules()))}
