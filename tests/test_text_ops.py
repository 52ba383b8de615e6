"""Inline fixtures for the text operators (edge rows from FIXTURES.md §C)."""

from pyspark.sql import functions as F

from lexiframe.functions import text as X
from lexiframe.operators import articles as AR
from lexiframe.operators import rules as RU
from lexiframe.plans import catalog as C

M = C.MASK


def _passage(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, stem string")
    out = AR.entity_passage(df).select("id", "passage", "sentlength").orderBy("id").collect()
    return {r.id: (r.passage, r.sentlength) for r in out}


def test_entity_passage_positions(spark):
    res = _passage(spark, [
        (1, "Smith came. B x. C y. D z.", "smith"),            # first sentence
        (2, "A a. B b. Smithson met. C c. D d.", "smith"),     # middle, suffix allowed
        (3, "A a. B b. Last Smith.", "smith"),                # last
        (4, "Only Smith here", "smith"),                      # only sentence
        (5, "A a. Smith one. Smith two. B b. C c.", "smith"),  # adjacent hits
        (6, "Smith x. Smith x. A a.", "smith"),               # repeated sentence (after masking)
        (7, "Nothing here. At all.", "smith"),                # no hit
        (8, "", "smith"),                                     # empty text
        (9, "Blacksmith works. A a.", "smith"),               # stem inside a longer word: no hit
    ])
    assert res[1] == (f"{M} came. B x.", 2)
    assert res[2] == (f"B b. {M} met. C c.", 3)
    assert res[3] == (f"B b. Last {M}.", 2)
    assert res[4] == (f"Only {M} here", 1)
    assert res[5] == (f"A a. {M} one. {M} two. B b.", 4)
    assert res[6] == (f"{M} x. A a.", 2)
    assert res[7] == ("", 0)
    assert res[8] == ("", 0)
    assert res[9] == ("", 0)


def test_neighbour_sentences_true_positions(spark):
    df = spark.createDataFrame([(1, "A a. X hit. A a. B b. C c.", "hit")], "id int, text string, stem string")
    rows = AR.neighbour_sentences(df).select("pos", "sentence").orderBy("pos").collect()
    assert [(r.pos, r.sentence) for r in rows] == [(1, "A a."), (2, "X hit."), (3, "A a.")]


def test_rules_prefix_and_proximity(spark):
    df = spark.createDataFrame([
        (1, "the big red fox of", "zz"),
        (2, "the a b c d e f of", "zz"),        # 6 words between: at the limit
        (3, "the a b c d e f g of", "zz"),      # 7 between: one beyond
        (4, "of x the", "zz"),                   # reversed order
        (5, "bathe often", "zz"),                # inside longer words: no word start
    ], "id int, text string, stem string")
    rule = dict(rule_id="p", scope="doc", proximity=("the", "of", 6))
    got = {r.id: r.p for r in df.select("id", RU.compile_rule(rule).alias("p")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


def test_rule_sentence_scope_mask_and_negation(spark):
    df = spark.createDataFrame([
        (1, "Smith and Jones met. Other text.", "smith"),
        (2, "Smith met. Jones and Brown.", "smith"),        # and in the neighbour sentence only
        (3, "Smith and Jones for all.", "smith"),           # forbidden term present
    ], "id int, text string, stem string")
    df = AR.entity_passage(df)
    rule = dict(rule_id="r", scope="sentence", any_of=["and"], none_of=["for", "was"], mask=True)
    got = {r.id: r.r for r in df.select("id", RU.compile_rule(rule).alias("r")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_clean_tokens_and_lemma(spark):
    df = spark.createDataFrame([("The cats, 42 dogs; a x les chats!",)], "t string")
    toks = df.select(AR.clean_tokens(F.col("t")).alias("c")).first().c
    assert toks == ["cats", "dogs", "chats"]
    lem = spark.createDataFrame([(["is", "les", "chat"],)], "t array<string>").select(AR.lemmatize(F.col("t")).alias("l")).first().l
    assert lem == ["be", "le", "chat"]


def test_ngrams_and_sentences(spark):
    df = spark.createDataFrame([("Hello world. This is it! Ok? end",)], "t string")
    r = df.select(X.sentences(F.col("t")).alias("s"), X.ngrams(X.word_tokens(F.col("t")), 2).alias("g")).first()
    assert r.s == ["Hello world.", "This is it!", "Ok?", "end"]
    assert r.g[:2] == ["hello world", "world this"]
