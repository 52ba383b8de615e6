"""Tables in place of literals: lemmas, terms and namesake rules."""

import random
import re

from pyspark.sql import functions as F

from lexiframe.operators import lexicon as LX
from lexiframe.operators import namesakes as NS


def test_lemmas_keep_order_and_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["hot", "hot", "a", f"w{rng.randrange(3000)}"]) for _ in range(rng.randrange(60))]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, ["\0x", "", "hot"])]
    docs = spark.createDataFrame(rows, "id int, t array<string>")
    million = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("form"), F.concat(F.lit("l"), F.col("id") % 7).alias("lemma"))
    more = spark.createDataFrame([("hot", "warm"), ("hot", "zzz"), ("a", None), (None, "b"), ("\0x", "y")], "form string, lemma string")
    of = {f"w{i}": f"l{i % 7}" for i in range(3000)} | {"hot": "warm"}
    got = {r["id"]: r["lemmas"] for r in LX.lemmatize_join(docs, "id", "t", million.unionByName(more)).collect()}
    want = {i: [of.get(w, w) for w in t or []] for i, t in rows}
    assert {k: v for k, v in got.items() if k != 1002} == {k: v for k, v in want.items() if k != 1002}
    assert got[1002][1:] == ["", "warm"]
    assert LX.lemmatize_join(docs.limit(0), "id", "t", more).count() == 0


def test_terms_in_one_pass(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    texts = [(i, word(rng.randrange(200)).upper()) for i in range(60)] + [(100, None), (101, "")]
    terms = [(f"c{i % 4}", word(rng.randrange(1, 7))) for i in range(3000)] + [("c0", "ab"), ("c1", "ab"), ("c9", ""), ("c2", None), ("c0", "ab")]
    docs, lex = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "category string, term string")
    want = {}
    for i, t in texts:
        for c, _ in {(c, w) for c, w in terms if w is not None and t is not None and w in t.lower()}:
            want[i, c] = want.get((i, c), 0) + 1
    for max_chars in (20_000_000, 5000):  # one automaton, several
        got = {(r["id"], r["category"]): r["n_terms"] for r in LX.term_search(docs, "id", "text", lex, max_chars).collect()}
        assert got == want
    assert LX.term_search(docs, "id", "text", lex.limit(0)).count() == 0


def test_fifty_thousand_terms(spark):
    lex = spark.range(50_000).select((F.col("id") % 3).cast("string").alias("category"), F.concat(F.lit("t"), "id", F.lit(";")).alias("term"))
    docs = spark.range(200).select("id", F.concat(F.lit("T"), F.col("id") * 7, F.lit("; x t49999; "), F.repeat(F.lit("t123 "), 2000)).alias("text"))
    got = LX.term_search(docs, "id", "text", lex).groupBy("id").agg(F.sum("n_terms").alias("n")).collect()
    assert len(got) == 200 and all(r["n"] == 2 for r in got)


def test_namesakes(spark):
    rng = random.Random(4)
    words = ["Anna", "bell", "Bells", "cat", "x", "y_1", "é"]
    texts = [(i, rng.choice(["s1", "s2", None]), rng.choice([" ", ", ", ".\n"]).join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(300)]
    texts += [(900, "s1", None), (901, None, "")]
    rules = [("r1", None, "anna", "bel", 2), ("r2", "s1", "cat", "CAT", 3), ("r3", "s2", "É", "x", 1), ("r4", "s1", "bell", "bell", 1),
             ("r5", None, None, "x", 3), ("r6", None, "x", "", 3)]
    want = {}
    for i, stem, t in texts:
        w = [x.lower() for x in re.findall(r"\w+", t or "")]
        hits = [r for r, of, c, s, gap in rules if c and s and (of is None or of == stem) and any(
            w[a] == c.lower() and w[b].startswith(s.lower()) for a in range(len(w)) for b in range(a + 1, min(len(w), a + gap + 1)))]
        if hits:
            want[i] = hits
    arts = spark.createDataFrame(texts, "article_id int, stem string, text string")
    table = spark.createDataFrame(rules, "rule string, stem string, context string, surname string, gap int")
    for limit in (50_000, 0):
        kept, removed = NS.split(arts, table, broadcast_rules=limit)
        assert {r["article_id"]: r["rules"] for r in removed.collect()} == want
        assert sorted(r["article_id"] for r in kept.collect()) == sorted(i for i, _, _ in texts if i not in want)
    assert NS.split(arts, table.limit(0))[0].count() == len(texts)
