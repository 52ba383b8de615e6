"""Article text jobs: passages around the entity, cleaning, lemma lookup, length and punctuation
features. All are narrow, per-row expressions (higher-order array functions in the JVM): no
shuffle and no Python worker on the per-row path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import catalog as C


def _sentence_flags(text: str, stem: str) -> Column:
    """(``s`` the sentence, ``w`` whether it or a neighbour names the entity) in order. Each step is the argument of the
    next one and stands in the expression once, so that wherever Spark moves or copies the column, a filter or a
    projection, a row's sentences are split and searched once. The search is made only in sentences that hold the stem's
    letters (of stems in ASCII, whose case does not depend on neighbours)."""
    look = F.struct(X.stem_hit_rx(F.col(stem)).alias("rx"), F.lower(F.col(stem)).alias("low"),
                    (~F.regexp_like(F.col(stem), F.lit("^[ -~]*$"))).alias("any"), X.sentences(F.col(text)).alias("s"))

    def hits(r):
        return F.struct(r["s"].alias("s"), F.transform(r["s"], lambda s: (r["any"] | F.contains(F.lower(s), r["low"])) & F.regexp_like(s, r["rx"])).alias("h"))

    def near(r):
        n1 = F.greatest(F.size(r["h"]) - 1, F.lit(0))
        prev = F.concat(F.array(F.lit(False)), F.slice(r["h"], 1, n1))
        nxt = F.concat(F.slice(r["h"], 2, n1), F.array(F.lit(False)))
        z = F.arrays_zip(r["s"].alias("s"), r["h"].alias("h"), prev.alias("p"), nxt.alias("n"))
        return F.transform(z, lambda e: F.struct(e["s"].alias("s"), (e["h"] | e["p"] | e["n"]).alias("w")))

    return _bound(_bound(look, hits), near)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entity_passage(df: DataFrame, text: str = "text", stem: str = "stem", mask: str = C.MASK) -> DataFrame:
    """Sentences naming the entity (word starting with its stem, any case) plus the sentence before
    and after, masked (the entity word becomes the mask token); repeats are dropped keeping first-seen order.

    Adds ``passage_sents`` (kept, masked), ``passage`` (joined by a space), ``sentlength`` (kept count)."""
    masked = F.struct(X.mask_word_rx(F.col(stem)).alias("rx"), _sentence_flags(text, stem).alias("z"))

    def kept(r):
        return F.array_distinct(F.transform(F.filter(r["z"], lambda e: e["w"]), lambda e: F.regexp_replace(e["s"], r["rx"], F.lit("$1" + mask))))

    out = df.withColumn("passage_sents", _bound(masked, kept))
    return out.withColumn("passage", F.array_join("passage_sents", " ")).withColumn("sentlength", F.size("passage_sents"))


def neighbour_sentences(df: DataFrame, text: str = "text", stem: str = "stem") -> DataFrame:
    """Long form of the ±1 window: (``pos`` 1-based, ``sentence``) for every sentence that names the
    entity or touches one that does. Positions are true positions, repeats kept."""
    out = df.withColumn("_z", _sentence_flags(text, stem))
    return out.select(*df.columns, F.posexplode("_z").alias("pos", "_e")).filter(F.col("_e.w")).select(
        *[c for c in df.columns], (F.col("pos") + 1).alias("pos"), F.col("_e.s").alias("sentence"))


def clean_tokens(text: Column, stopwords: Sequence[str] = C.STOPWORDS) -> Column:
    """Lower-case; digits and punctuation except ``.`` become spaces; stopwords and one-character
    tokens dropped; remaining tokens in order."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}. \t\r\n]+", " ")
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(
        F.split(t, f"{X.SPACE}+"),
        lambda w: (w != "") & (F.length(w) > 1) & ~F.array_contains(stop, w),
    )


def lemma_map_col(pairs=C.LEMMAS) -> Column:
    """Form -> lemma as a map literal (a short fixed list; tables of any size go through
    ``lexicon.lemmatize_join``)."""
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def lemmatize(tokens: Column, pairs=C.LEMMAS) -> Column:
    m = lemma_map_col(pairs)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), t))


def length_raw(text: Column) -> dict[str, Column]:
    words = F.size(F.split(text, " "))
    chars = F.length(text)
    sents = F.size(F.split(text, r"\."))
    return {
        "words": words,
        "chars": chars,
        "sents": sents,
        "avg_word": X.r6(X.safe_div(chars, words)),
        "avg_sent": X.r6(X.safe_div(words, sents)),
    }


def length_narrow(tokens: Column) -> dict[str, Column]:
    joined = F.array_join(tokens, " ")
    n = F.size(tokens)
    return {
        "n_words": n,
        "n_chars": F.length(joined),
        "n_avg_word": X.r6(X.safe_div(F.length(joined), n)),
    }


def punct_features(text: Column) -> dict[str, Column]:
    words = F.size(X.space_tokens(text))
    comma = X.count_char(text, ",")
    return {
        "excl": X.count_char(text, "!"),
        "comma": comma,
        "comma_per_word": X.r6(X.safe_div(comma, words)),
    }
