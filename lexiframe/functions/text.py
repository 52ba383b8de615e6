"""Column expressions for text work. Everything here builds JVM-side expressions (regex, split,
higher-order array functions); nothing runs Python per row.

Regex patterns are written in the subset that Java regex and RE2 read the same way, so the
same pattern string can be used by the SQL oracle: word boundaries are spelled out as
``[^\\p{L}\\p{N}_]`` (``\\b`` and ``\\w`` differ between engines), whitespace is ``[ \\t\\r\\n]``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
SPACE = r"[ \t\r\n]"
SENT_SEP = "\x01"


def rx_escape(term: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)


def rx_alt(terms: Iterable[str]) -> str:
    return "|".join(rx_escape(t) for t in terms)


def prefix_rx(terms: Iterable[str] | str, case_insensitive: bool = True) -> str:
    """Term (or any of terms) at a word start; suffixes allowed (a stem search)."""
    if isinstance(terms, str):
        terms = [terms]
    body = rx_alt(terms)
    flag = "?i:" if case_insensitive else "?:"
    return f"(?:^|{NONWORD})({flag}{body})"


def word_rx(terms: Iterable[str] | str, case_insensitive: bool = True) -> str:
    """Whole-word term (or any of terms); multi-word terms allowed."""
    return prefix_rx(terms, case_insensitive) + f"(?:$|{NONWORD})"


def proximity_rx(a: str, b: str, max_gap: int) -> str:
    """Word ``a`` then word ``b`` with at most ``max_gap`` words between, either order."""
    gap = f"(?:{NONWORD}+{WORD}+){{0,{max_gap}}}{NONWORD}+"

    def one(x, y):
        return f"(?:^|{NONWORD})(?i:{rx_escape(x)}){gap}(?i:{rx_escape(y)})(?:$|{NONWORD})"

    return f"(?:{one(a, b)})|(?:{one(b, a)})"


def quoted(col: Column) -> Column:
    """Text of a column as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def mask_word_rx(stem_col: Column) -> Column:
    """Pattern (as a column, stem varies per row) matching the whole word that starts with the stem.
    Group 1 is the boundary character kept in front of the mask."""
    return F.concat(F.lit(f"(^|{NONWORD})(?i:"), quoted(stem_col), F.lit(f"){WORD}*"))


def stem_hit_rx(stem_col: Column) -> Column:
    return F.concat(F.lit(f"(?:^|{NONWORD})(?i:"), quoted(stem_col), F.lit(")"))


def sentences(text: Column) -> Column:
    """Ordered sentences: a boundary is ``.``, ``!`` or ``?`` followed by whitespace.
    A separator character is inserted first (portable to engines without look-behind)."""
    marked = F.regexp_replace(text, f"([.!?]){SPACE}+", "$1" + SENT_SEP)
    return F.filter(F.split(marked, SENT_SEP), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased word tokens (letters, digits, underscore)."""
    return F.filter(F.split(F.lower(text), f"{NONWORD}+"), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by one space, in order. Built from ``n`` shifted copies of the token
    array zipped together, so no lambda indexes the token array (which could be re-evaluated per
    element once projections are collapsed)."""
    if n == 1:
        return tokens
    size = F.size(tokens)
    shifted = [F.slice(tokens, k + 1, F.greatest(size, F.lit(1))).alias(f"g{k}") for k in range(n)]
    z = F.arrays_zip(*shifted)
    full = F.filter(z, lambda e: e[f"g{n - 1}"].isNotNull())
    return F.transform(full, lambda e: F.concat_ws(" ", *[e[f"g{k}"] for k in range(n)]))


def ngrams_upto(tokens: Column, n_max: int) -> Column:
    out = tokens
    for n in range(2, n_max + 1):
        out = F.concat(out, ngrams(tokens, n))
    return out


def count_char(text: Column, ch: str) -> Column:
    """Occurrences of one character (or fixed substring of length 1)."""
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def count_rx(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(c: Column) -> Column:
    """Doubles leave every job rounded to 6 places (half-up, as the SQL oracle)."""
    return F.round(c.cast("double"), 6)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 for a TIMESTAMP_NTZ column, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def pad_id(col: str) -> Column:
    """An id with leading zeros, ten digits at least; longer ids are not cut."""
    text = F.col(col).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(10)), "0")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ASCII_PUNCT_RX = r"[!-/:-@\[-`{-~]"  # the 32 ASCII punctuation marks as ranges


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, ASCII_PUNCT_RX, "")
