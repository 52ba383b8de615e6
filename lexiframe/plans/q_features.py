"""The article feature frame (I25) and its groups (I6, I8-I13), all from one chain: entity passage -> cleaned
tokens -> lemmas.

Polarity, entity types and punctuation are read from the passage; lexicons, tags, narrow lengths and rules from
the cleaned, lemmatised passage; wide lengths from the whole article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as C
from . import sqlparts as S
from . import views as V
from .registry import register
from ..functions import text as X
from ..operators import articles as AR
from ..operators import rules as RU
from ..operators.rules import lit

N_MAX = 2
SUBSTRING = ("representative", "federal")
LEMMA = dict(C.LEMMAS)
MASK = C.MASK.lower()


def lemma_term(term: str) -> str:
    return " ".join(LEMMA.get(w, w) for w in term.split(" "))


def terms_of(category: str) -> list[str]:
    return sorted({lemma_term(t) for c, t in C.LEXICON if c == category})


CLEAN_SQL = (f"list_filter(regexp_split_to_array(regexp_replace(lower(p.passage), '[^\\p{{L}}. \\t\\r\\n]+', ' ', 'g'), "
             f"'{S.SP}+'), lambda w: w <> '' AND length(w) > 1 AND NOT list_contains({S.str_list(C.STOPWORDS)}, w))")
LEMMA_SQL = "CASE t " + " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in C.LEMMAS) + " ELSE t END"
CHAIN_SQL = f"""
chain1 AS (SELECT a.article_id, a.entity, a.region, a.stem, a.text, a.date, a.publisher, a.label, p.passage, p.sentlength,
                  list_transform({CLEAN_SQL}, lambda t: {LEMMA_SQL}) AS lem FROM art a JOIN passage p USING (article_id)),
chain2 AS (SELECT *, array_to_string(lem, ' ') AS lemma_text, len(lem) AS n_lem FROM chain1),
chain AS (SELECT *, {S.word_tokens_sql('lemma_text')} AS tok, {S.word_tokens_sql('passage')} AS ptok,
                 lower(passage) AS low_passage, len(string_split(text, ' ')) AS w, length(text) AS c, len(string_split(text, '.')) AS s FROM chain2),
feat AS (SELECT *, list_distinct(tok || list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS grams,
         string_split(lemma_text, '.') AS lemma_sents FROM chain)"""


def chain(spark, d, articles: DataFrame | None = None) -> DataFrame:
    """article_id, entity, region, stem, text, passage, sentlength and what the steps make of the passage; and the
    label, if the articles have one."""
    a = AR.entity_passage(V.articles(spark, d) if articles is None else articles)
    kept = ["article_id", "entity", "region", "stem", "text", "date", "publisher", "passage", "sentlength", "label"]
    a = a.select(*[c for c in kept if c in a.columns])
    a = a.withColumn("lem", AR.lemmatize(AR.clean_tokens(F.col("passage"))))
    a = a.withColumn("lemma_text", F.array_join("lem", " ")).withColumn("n_lem", F.size("lem")).drop("lem")
    a = a.withColumn("tok", X.word_tokens(F.col("lemma_text"))).withColumn("ptok", X.word_tokens(F.col("passage")))
    a = a.withColumn("w", F.size(F.split("text", " ")).cast("long")).withColumn("c", F.length("text").cast("long")).withColumn(
        "s", F.size(F.split("text", r"\.")).cast("long"))
    return a.withColumn("grams", X.ngrams_upto(F.col("tok"), N_MAX)).withColumn("lemma_sents", F.split("lemma_text", r"\."))


# A feature is (name, Spark SQL, DuckDB SQL). Both are texts, so that the queries can be listed without a session.
Feature = tuple[str, str, str]


def arr(items) -> str:
    return "array(" + ", ".join(map(lit, items)) + ")"


def ratio(name: str, a: tuple[str, str], b: tuple[str, str]) -> Feature:
    """A quotient of two counts to six places. Rounded in whole numbers, half up, so that engines agree on ties."""
    (p, q), (m, n) = a, b
    return (name, f"(case when ({m}) <> 0 then ((2000000 * cast({p} as bigint) + ({m})) div (2 * cast({m} as bigint))) / 1000000D end)",
            f"(CAST((2000000 * CAST({q} AS BIGINT) + ({n})) // nullif(2 * CAST({n} AS BIGINT), 0) AS DOUBLE) / 1000000)")


def flag(name: str, n: tuple[str, str]) -> Feature:
    return name, f"cast(({n[0]}) > 0 as int)", f"CAST(({n[1]}) > 0 AS INTEGER)"


def same(text: str) -> tuple[str, str]:
    return text, text


N_LEM = same("n_lem")


def length_raw() -> list[Feature]:
    return [("words", "w", "w"), ("chars", "c", "c"), ("sents", "s", "s"),
            ratio("avg_word", same("c"), same("w")), ratio("avg_sent", same("w"), same("s"))]


def length_narrow() -> list[Feature]:
    chars = same("length(lemma_text)")
    return [("n_words", "n_lem", "n_lem"), ("n_chars", *chars), ratio("n_avg_word", chars, N_LEM)]


def punctuation() -> list[Feature]:
    excl, comma = (same(f"(length(passage) - length(replace(passage, '{ch}', '')))") for ch in "!,")
    return [("excl", *excl), ("comma", *comma), ratio("comma_per_word", comma, N_LEM)]


def lexicon_count(category: str) -> tuple[str, str]:
    """Distinct terms of a category in the lemmas: anywhere in the text, or as whole words."""
    terms = terms_of(category)
    if category in SUBSTRING:
        return (f"size(filter({arr(terms)}, t -> contains(lemma_text, t)))",
                f"len(list_filter({S.str_list(terms)}, lambda t: contains(lemma_text, t)))")
    return f"size(array_intersect(grams, {arr(terms)}))", f"len(list_intersect(grams, {S.str_list(terms)}))"


def other_capitals() -> tuple[str, str]:
    caps = sorted(t for _, t in C.REGION_CAPITALS if t not in C.AMBIGUOUS_TERMS)
    cases = " ".join(f"WHEN {S.q(r)} THEN {S.q(t)}" for r, t in C.REGION_CAPITALS)
    own = f"CASE region {cases} ELSE '' END"
    skip = f"CASE WHEN entity IN ({', '.join(S.q(e) for e in C.AMBIGUOUS_ENTITIES)}) THEN 0 ELSE "
    return (f"{skip} size(filter(array_intersect(tok, {arr(caps)}), t -> t <> {own})) END",
            f"{skip} len(list_filter(list_intersect(list_distinct(tok), {S.str_list(caps)}), lambda t: t <> {own})) END")


def lexicons() -> list[Feature]:
    out = []
    for name, n in [*((c, lexicon_count(c)) for c in C.LEXICON_CATEGORIES), ("other_capital", other_capitals())]:
        out += [(f"{name}_count", *n), ratio(f"{name}_share", n, N_LEM), flag(f"{name}_flag", n)]
    return out


def hits(tokens: str, terms) -> tuple[str, str]:
    terms = sorted(set(terms))
    return (f"size(filter({tokens}, x -> array_contains({arr(terms)}, x)))",
            f"len(list_filter({tokens}, lambda x: list_contains({S.str_list(terms)}, x)))")


def entity_types() -> list[Feature]:
    out, counts, sents = [], [], same("sentlength")
    for ty in C.ENTITY_TYPES:
        n = hits("ptok", [w for w, t in C.GAZETTEER if t == ty])
        counts.append(n)
        out += [(f"{ty.lower()}_count", *n), ratio(f"{ty.lower()}_per_sentence", n, sents), flag(f"{ty.lower()}_flag", n)]
    total = tuple("(" + " + ".join(c[i] for c in counts) + ")" for i in (0, 1))
    return out + [("all_count", *total), ratio("all_per_sentence", total, sents), flag("all_flag", total)]


def polarity() -> list[Feature]:
    """Shares, capped; nothing for an empty passage (the smaller of nothing and a cap would be the cap)."""
    parts = []
    for kind in ("positive", "negative"):
        n = hits("ptok", [w for k, w in C.POLARITY if k == kind])
        parts.append((kind, f"least(try_divide(cast({n[0]} as double), size(ptok)), 0.3D)", f"least(CAST({n[1]} AS DOUBLE) / nullif(len(ptok), 0), 0.3)"))
    parts.append(("neutral", *(f"1 - {parts[0][i]} - {parts[1][i]}" for i in (1, 2))))
    return [(k, f"round(CASE WHEN size(ptok) > 0 THEN {c} END, 6)", f"round(CASE WHEN len(ptok) > 0 THEN {q} END, 6)") for k, c, q in parts]


def tag_shares() -> list[Feature]:
    return [ratio(f"share_{tag.lower()}", hits("tok", [lemma_term(w) for w, t in C.POS_TAGS if t == tag]), ("size(tok)", "len(tok)"))
            for tag in C.POS_TAG_SET]


def entities() -> list[Feature]:
    n = (f"size(filter({arr(C.ENTITY_STEMS)}, s -> s <> stem AND contains(lemma_text, s)))",
         f"len(list_filter({S.str_list(C.ENTITY_STEMS)}, lambda s: s <> stem AND contains(lemma_text, s)))")
    return [("n_entities", *n), ratio("entities_share", n, N_LEM), flag("entities_flag", n)]


def squares() -> list[Feature]:
    """Squares of two lexicon shares and counts, of the narrow word count and of the five wide lengths."""
    base = {n: (c, q) for n, c, q in [*lexicons(), *length_narrow(), *length_raw()]}
    names = ["representative_share", "representative_count", "federal_share", "federal_count", "n_words", "words", "chars", "sents", "avg_word", "avg_sent"]
    return [(f"p_{n}", *(f"round(CAST({e} AS DOUBLE) * CAST({e} AS DOUBLE), 6)" for e in base[n])) for n in names]


def has_word(terms) -> tuple[str, str]:
    """Whether a word of the lemmatised passage starts with one of the terms."""
    terms = [lemma_term(t) for t in terms]
    return RU.has_word("lemma_text", terms), f"regexp_matches(lemma_text, {S.q(S.prefix_rx(terms))})"


def rule(r: dict) -> Feature:
    """A rule over the lemmatised passage, or over its sentences; the mask is a token of theirs."""
    n_entities = entities()[0]
    spark = RU.rule_expr(r, "lemma_sents", "lemma_text", form=lemma_term, mask=MASK, n_entities=n_entities[1])
    make = S.word_rx if r.get("whole") else S.prefix_rx

    def cond(x):
        parts = [f"regexp_matches({x}, {S.q(make([lemma_term(t) for t in r[k]]))})" for k in ("any_of", "any_of2") if r.get(k)]
        parts += [f"regexp_matches({x}, {S.q(make(lemma_term(t)))})" for t in r.get("all_of", [])]
        if r.get("none_of"):
            parts.append(f"NOT regexp_matches({x}, {S.q(make([lemma_term(t) for t in r['none_of']]))})")
        if r.get("proximity"):
            a, b, n = r["proximity"]
            parts.append(f"regexp_matches({x}, {S.q(S.proximity_rx(lemma_term(a), lemma_term(b), n))})")
        if r.get("mask"):
            parts.append(f"contains({x}, {S.q(MASK)})")
        return "(" + (" AND ".join(parts) or "true") + ")"

    duck = f"len(list_filter(lemma_sents, lambda x: {cond('x')})) > 0" if r["scope"] == "sentence" else cond("lemma_text")
    if r.get("min_entities") is not None:
        duck = f"({duck} AND {n_entities[2]} > {r['min_entities']})"
    return r["rule_id"], spark, f"CAST({duck} AS INTEGER)"


def interview() -> Feature:
    """Rule I23 over the lemmatised passage, with the precedence of the original expression (``and`` binds tighter)."""
    w = {k: has_word(v) for k, v in C.INTERVIEW_WORDS.items()}
    masked = (f"contains(lemma_text, {lit(MASK)})", f"contains(lemma_text, {S.q(MASK)})")
    e = [f"({w['interview'][i]} OR {w['ask'][i]} OR {w['answer1'][i]} OR {w['asking'][i]}"
         f" OR ({w['answering'][i]} AND {w['question'][i]}) OR ({w['talk'][i]} AND {masked[i]}))" for i in (0, 1)]
    return "interview", f"cast({e[0]} as int)", f"CAST({e[1]} AS INTEGER)"


def meeting() -> Feature:
    """Rule I24 over the lemmatised passage."""
    names, title = has_word(C.MEETING_RULE["names"]), has_word(C.MEETING_RULE["title"])
    return "meeting", f"cast(({names[0]} AND {title[0]}) as int)", f"CAST(({names[1]} AND {title[1]}) AS INTEGER)"


def rules(ids) -> list[Feature]:
    return [rule(r) for r in RU.rules_by_id(ids)]


GROUPS = {
    "length_narrow": length_narrow, "punct_features": punctuation, "poly_features": squares, "lexicon_features": lexicons,
    "entity_type_features": entity_types, "polarity_features": polarity, "pos_share_features": tag_shares,
    **{k: (lambda ids=ids: rules(ids)) for k, ids in C.RULE_GROUPS.items()},
}


def select_sql(features: list[Feature]) -> str:
    return S.with_(S.ART, S.PASSAGE_ROWS, CHAIN_SQL) + "SELECT article_id, " + ",\n  ".join(f"{q} AS {n}" for n, _, q in features) + " FROM feat"


def _register(key, features):
    def fn(spark, d):
        return chain(spark, d).select("article_id", *[F.expr(c).alias(n) for n, c, _ in features])

    fn.__name__ = key
    register(key, sql=select_sql(features))(fn)


def all_features() -> list[Feature]:
    return [("sentlength", "sentlength", "sentlength"), *length_raw(), *length_narrow(), *punctuation(), *squares(), *lexicons(),
            *entity_types(), *polarity(), *tag_shares(), *entities(), *rules([r["rule_id"] for r in C.RULES])]


def feature_names() -> list[str]:
    return [n for n, _, _ in all_features()]


for _k, _f in GROUPS.items():
    _register(_k, _f())
_register("feature_frame", all_features())
