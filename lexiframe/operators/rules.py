"""Data-driven rules engine: a small rules list compiles (once, on the driver) into boolean expressions, the same
for feature frames, scored rows and panels. Sentence-scope rules test every sentence of an array with ``exists``;
document-scope rules test the whole text. Every rule list becomes one regex alternation, so a text is scanned once per
list, not once per term."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import catalog as C


def lit(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_word(x: str, terms: Sequence[str], whole: bool = False) -> str:
    """Whether a word of ``x`` starts with one of the terms, or is one."""
    return f"regexp_like({x}, {lit((X.word_rx if whole else X.prefix_rx)(list(terms)))})"


def rule_expr(rule: Mapping, sents: str, text: str, form: Callable[[str], str] = str, mask: str = C.MASK,
              n_entities: str = "n_entities") -> str:
    """A rule as Spark SQL of 0 or 1 over the columns ``sents`` (array) or ``text``. ``form`` gives the form that a
    term has in them, ``mask`` is the token that stands for the entity."""

    def cond(x: str) -> str:
        parts = [has_word(x, [form(t) for t in rule[k]], rule.get("whole", False)) for k in ("any_of", "any_of2") if rule.get(k)]
        parts += [has_word(x, [form(t)], rule.get("whole", False)) for t in rule.get("all_of", [])]
        if rule.get("none_of"):
            parts.append("NOT " + has_word(x, [form(t) for t in rule["none_of"]], rule.get("whole", False)))
        if rule.get("proximity"):
            a, b, n = rule["proximity"]
            parts.append(f"regexp_like({x}, {lit(X.proximity_rx(form(a), form(b), n))})")
        if rule.get("mask"):
            parts.append(f"contains({x}, {lit(mask)})")
        return "(" + (" AND ".join(parts) or "true") + ")"

    flag = f"exists({sents}, x -> {cond('x')})" if rule["scope"] == "sentence" else cond(text)
    if rule.get("min_entities") is not None:
        flag = f"({flag} AND {n_entities} > {rule['min_entities']})"
    return f"cast({flag} as int)"


def compile_rule(rule: Mapping, sents: str = "passage_sents", text: str = "text", **options) -> Column:
    """``rule_expr`` as a column."""
    return F.expr(rule_expr(rule, sents, text, **options))


def rules_by_id(ids):
    by = {r["rule_id"]: r for r in C.RULES}
    return [by[i] for i in ids]


def any_word(x: Column, terms) -> Column:
    return F.regexp_like(x, F.lit(X.prefix_rx(terms)))


def interview_flags(text: Column, stem_hit: Column) -> dict[str, Column]:
    """Interview rule written with the original operator precedence (``and`` binds tighter than
    ``or``) and in the form presumably meant."""
    w = {k: any_word(text, v) for k, v in C.INTERVIEW_WORDS.items()}
    literal = w["interview"] | (w["ask"] | w["answer1"] | w["asking"] | (w["answering"] & w["question"])) | (
        w["talk"] & stem_hit)
    meant = ((w["interview"] | w["ask"] | w["answer1"] | w["asking"] | w["answering"]) & w["question"]) | (
        w["talk"] & stem_hit)
    return {"interview_literal": literal.cast("int"), "interview_meant": meant.cast("int")}
