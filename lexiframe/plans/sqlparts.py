"""Building blocks of the DuckDB oracle SQL (the independent check of every exact query).
The oracle deliberately uses a different formulation where it can (windows instead of
higher-order functions, ASOF JOIN instead of a union+window)."""

from __future__ import annotations

from . import catalog as C

NW = r"[^\p{L}\p{N}_]"
WD = r"[\p{L}\p{N}_]"
SP = r"[ \t\r\n]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pad_id(expr: str) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), CAST(greatest(length(CAST({expr} AS VARCHAR)), 10) AS INTEGER), '0')"


def values(rows, cols, alias: str = "t") -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else ("NULL" if v is None else str(v)) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


STEMS = values(list(enumerate(C.ENTITY_STEMS)), ["entity_key", "stem"], "s")

ART = f"""
art AS (
  SELECT d.doc_id AS article_id, d.text, d.lang, d.source AS publisher, n.n_nationkey AS entity_key,
         n.n_name AS entity, r.r_name AS region, s.stem, CAST(o.o_orderdate AS DATE) AS date,
         l.quality AS label, l.toxic AS appointment
  FROM documents d
  JOIN orders o ON d.doc_id = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN {STEMS} ON s.entity_key = n.n_nationkey
  LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def sentences_sql(col: str) -> str:
    return (f"list_filter(string_split(regexp_replace({col}, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: s <> '')")


def word_tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '{NW}+'), lambda t: t <> '')"


def space_tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{SP}+'), lambda t: t <> '')"


def rx_escape(t: str) -> str:
    import re
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", t)


def prefix_rx(terms) -> str:
    if isinstance(terms, str):
        terms = [terms]
    return f"(?:^|{NW})(?i:{'|'.join(rx_escape(t) for t in terms)})"


def word_rx(terms) -> str:
    return prefix_rx(terms) + f"(?:$|{NW})"


def proximity_rx(a, b, n) -> str:
    gap = f"(?:{NW}+{WD}+){{0,{n}}}{NW}+"

    def one(x, y):
        return f"(?:^|{NW})(?i:{rx_escape(x)}){gap}(?i:{rx_escape(y)})(?:$|{NW})"

    return f"(?:{one(a, b)})|(?:{one(b, a)})"


def stem_case(stem_col: str, make) -> str:
    """Per-entity constant patterns: RE2 compiles a non-constant pattern on every row (slow with
    Unicode classes), so the oracle switches over the fixed stems instead."""
    return "CASE " + stem_col + " " + " ".join(f"WHEN {q(st)} THEN {make(st)}" for st in C.ENTITY_STEMS) + " END"


def stem_hit_sql(x: str, stem_col: str) -> str:
    return stem_case(stem_col, lambda st: f"regexp_matches({x}, {q(f'(?:^|{NW})(?i:{rx_escape(st)})')})")


def stem_mask_sql(x: str, stem_col: str) -> str:
    return stem_case(stem_col, lambda st: f"regexp_replace({x}, {q(f'(^|{NW})(?i:{rx_escape(st)}){WD}*')}, "
                                          f"{q(chr(92) + '1' + C.MASK)}, 'g')")


# passage sentences: one row per kept, masked, first-seen sentence of every article
PASSAGE_ROWS = f"""
sent AS (
  SELECT a.article_id, a.stem, u.sentence, u.pos
  FROM art a, unnest({sentences_sql('a.text')}) WITH ORDINALITY AS u(sentence, pos)
),
flag AS (
  SELECT s.article_id, s.pos,
         {stem_mask_sql('s.sentence', 's.stem')} AS masked,
         {stem_hit_sql('s.sentence', 's.stem')} AS hit
  FROM sent s
),
win AS (
  SELECT *, coalesce(lag(hit) OVER w, false) OR hit OR coalesce(lead(hit) OVER w, false) AS keep
  FROM flag WINDOW w AS (PARTITION BY article_id ORDER BY pos)
),
psent AS (
  SELECT article_id, pos, masked FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id, masked ORDER BY pos) AS rn FROM win WHERE keep
  ) WHERE rn = 1
),
passage AS (
  SELECT a.article_id, coalesce(string_agg(p.masked, ' ' ORDER BY p.pos), '') AS passage,
         count(p.pos) AS sentlength
  FROM art a LEFT JOIN psent p USING (article_id)
  GROUP BY a.article_id
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
