"""Lexicon joins and lexicon-driven features.

Forms of the same question "which lexicon terms occur in this text":
* ``word_join``: n-grams exploded and equi-joined to a broadcast lexicon; only matches reach the
  shuffle (map-side partial count). Scales to any lexicon that fits a broadcast and to any corpus.
* ``term_counts``: ``array_intersect(ngrams, literal terms)`` per row; hash based, narrow, no shuffle.
  Used inside the wide feature row where the lexicon is a bounded fixed list.
* ``term_search``: terms anywhere in a text, by one automaton over all of them that reads a text once;
  for lexicons of any size.
All count a term once per text (presence), multi-word terms by n-gram equality.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def max_term_words(lex: Sequence[tuple[str, str]]) -> int:
    return max(len(t.split(" ")) for _, t in lex)


def word_join(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, n_max: int) -> DataFrame:
    """(id, category, n_terms): distinct whole-word lexicon terms per text and category."""
    toks = df.select(id_col, X.word_tokens(F.col(text_col)).alias("_t"))
    grams = toks.select(id_col, F.explode(X.ngrams_upto(F.col("_t"), n_max)).alias("term"))
    hits = grams.join(F.broadcast(lexicon), "term").select(id_col, "category", "term").distinct()
    return hits.groupBy(id_col, "category").agg(F.count(F.lit(1)).alias("n_terms"))


def substring_join(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(id, category, n_terms): lexicon terms contained anywhere in the lower-cased text
    (a broadcast nested-loop join on ``contains``; the lexicon side is a bounded list)."""
    low = df.select(id_col, F.lower(F.col(text_col)).alias("_low"))
    hits = low.join(F.broadcast(lexicon), F.col("_low").contains(F.col("term")))
    return hits.groupBy(id_col, "category").agg(F.count_distinct("term").alias("n_terms"))


def term_search(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, max_chars: int = 20_000_000) -> DataFrame:
    """(id, category, n_terms): distinct terms of a category that occur anywhere in the lower-cased text.

    The terms become an automaton (goto and failure links), which finds all of them in one pass over a text. An
    automaton has at most about ``max_chars`` characters of terms; a larger lexicon is dealt by hash over as many automata
    as it needs, each with a pass of its own, and the counts are added. Null texts and terms match nothing, the empty
    term is in every text; a term may have several categories. ``id_col`` is unique."""
    spark = df.sparkSession
    terms = lexicon.where("term IS NOT NULL").select("category", "term").distinct()
    chars = terms.agg(F.sum(F.length("term") + 8)).first()[0] or 0
    parts = chars // max_chars + 1
    low = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    kind = low.schema["id"].dataType.simpleString()
    category = terms.schema["category"].dataType.simpleString()

    def search(part: int) -> DataFrame:
        mine = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        found = mine.groupBy("term").agg(F.collect_list("category").alias("c")).collect()  # at most about max_chars characters
        shared = spark.sparkContext.broadcast([(r["term"], list(r["c"])) for r in found])

        def run(batches):
            automaton, always = ahocorasick.Automaton(), []
            for i, (term, categories) in enumerate(shared.value):
                if term:
                    automaton.add_word(term, i)
                else:
                    always = categories
            automaton.make_automaton()
            for b in batches:
                ids, keys, counts = [], [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    hits = {i for _, i in automaton.iter(text)} if len(automaton) else ()
                    n = Counter(c for i in hits for c in shared.value[i][1])
                    n.update(always)
                    ids += [key] * len(n)
                    keys += n
                    counts += n.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.string()), pa.array(counts, pa.int64())],
                                                 ["id", "category", "n_terms"])

        return low.mapInArrow(run, f"id {kind}, category string, n_terms long")

    out = reduce(DataFrame.unionAll, [search(p) for p in range(parts)])
    if parts > 1:
        out = out.groupBy("id", "category").agg(F.sum("n_terms").alias("n_terms"))
    return out.select(F.col("id").alias(id_col), F.col("category").cast(category).alias("category"), "n_terms")


HOT_FORMS = 1000  # forms looked up in a broadcast table; every other form has less than 1/1000 of the tokens


def lemmatize_join(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame, out_col: str = "lemmas") -> DataFrame:
    """(id, lemmas): every token replaced by its lemma in a table (form, lemma) of any size, in the order of the text.

    The ``HOT_FORMS`` most frequent forms are looked up in a broadcast table of as many rows, so that no key of the join
    with the whole table is hot; their tokens pass that join under keys that no form has. A token that is no form
    stays, as one that begins with a NUL does; of several lemmas the smallest counts. A null array gives an empty one. ``id_col`` is unique."""
    table = lemmas.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode_outer(tokens_col).alias("pos", "token"))
    hot = (tokens.where("token IS NOT NULL").groupBy("token").count().orderBy(F.desc("count"), "token").limit(HOT_FORMS)
           .join(table, F.col("token") == F.col("form"), "left").select(F.col("token").alias("h"), F.coalesce("lemma", "token").alias("of_hot")))
    known = tokens.join(F.broadcast(hot), F.col("token") == F.col("h"), "left")
    spread = F.concat(F.lit("\0"), F.xxhash64("id", "pos").cast("string"))  # hot tokens and texts without tokens
    keyed = known.withColumn("key", F.when(F.col("token").isNull() | F.col("of_hot").isNotNull(), spread).otherwise(F.col("token")))
    found = keyed.join(table.where(~F.startswith("form", F.lit("\0"))), F.col("key") == F.col("form"), "left")
    lemma = F.coalesce("of_hot", "lemma", "token")
    entry = F.when(F.col("token").isNotNull(), F.struct("pos", lemma.alias("lemma")))
    return found.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("l")).select(
        F.col("id").alias(id_col), F.col("l.lemma").alias(out_col))


def term_counts(grams: Column, terms: Sequence[str]) -> Column:
    """Number of distinct ``terms`` present in the n-gram array."""
    return F.size(F.array_intersect(grams, F.array(*[F.lit(t) for t in sorted(set(terms))])))


def token_hits(tokens: Column, terms: Sequence[str]) -> Column:
    """Number of tokens (with repeats) that are in ``terms``."""
    arr = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return F.size(F.filter(tokens, lambda t: F.array_contains(arr, t)))
