"""Word lists, rules and small lookup tables.

The driver corpus is invented prose in English, French, German and Spanish, so every list
below is made of words that occur in it. All lists are plain data; the engines that read
them (lexicon joins, rules compiler) take any other list of the same shape.
"""

from __future__ import annotations

# ---- fixed values: mask token, entity stems (one per nation key 0..24), region capitals ----
MASK = "PERSONA"

ENTITY_STEMS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "this",
    "are", "from", "de", "la", "le", "les", "des", "une", "pour", "der",
    "die", "und", "von", "que", "los",
]

REGION_CAPITALS = [
    ("AFRICA", "that"),
    ("AMERICA", "les"),
    ("ASIA", "der"),
    ("EUROPE", "que"),
    ("MIDDLE EAST", "with"),
]

# one ambiguous capital term and one ambiguous entity for the exclusion join
AMBIGUOUS_TERMS = ["les"]
AMBIGUOUS_ENTITIES = ["NATION_7"]

# ---- fixed values: publisher lists ----
PUBLISHERS_2010 = ["src0", "src1", "src2", "src3", "src5", "src8", "src13"]
PUBLISHERS_2012 = ["src1", "src4", "src9", "src10", "src16", "src17", "src18", "src19"]

# ---- fixed values: lexicons (category, term); multi-word terms allowed ----
LEXICON = [
    ("foreign_city", "paris"), ("foreign_city", "el"), ("foreign_city", "den"), ("foreign_city", "du"),
    ("foreign_country", "es"), ("foreign_country", "en"), ("foreign_country", "au"), ("foreign_country", "zu"),
    ("economy", "for"), ("economy", "was"), ("economy", "par"), ("economy", "mit"), ("economy", "con"),
    ("economy", "of the"), ("economy", "de la"),
    ("social", "on"), ("social", "be"), ("social", "qui"), ("social", "sich"), ("social", "para"),
    ("social", "in der"), ("social", "que el"),
    ("mid_officials", "by"), ("mid_officials", "dans"), ("mid_officials", "auf"), ("mid_officials", "por"),
    ("representative", "as"), ("representative", "sur"), ("representative", "nicht"), ("representative", "su"),
    ("representative", "it is"),
    ("federal", "at"), ("federal", "est"), ("federal", "ist"), ("federal", "del"), ("federal", "and the"),
]
LEXICON_CATEGORIES = [
    "foreign_city", "foreign_country", "economy", "social", "mid_officials", "representative", "federal",
]

# ---- fixed values: polarity words ----
POLARITY = [
    ("positive", "good"), ("positive", "able"), ("positive", "bien"), ("positive", "gut"), ("positive", "bueno"),
    ("positive", "ble"), ("positive", "mente"),
    ("negative", "not"), ("negative", "pas"), ("negative", "nicht"), ("negative", "no"), ("negative", "ne"),
]

# ---- fixed values: part-of-speech tags of frequent words ----
POS_TAGS = [
    ("the", "DET"), ("a", "DET"), ("this", "DET"), ("la", "DET"), ("le", "DET"), ("les", "DET"),
    ("der", "DET"), ("die", "DET"), ("das", "DET"), ("el", "DET"), ("los", "DET"), ("las", "DET"),
    ("and", "CCONJ"), ("or", "CCONJ"), ("et", "CCONJ"), ("ou", "CCONJ"), ("und", "CCONJ"), ("y", "CCONJ"),
    ("of", "ADP"), ("in", "ADP"), ("on", "ADP"), ("with", "ADP"), ("de", "ADP"), ("von", "ADP"),
    ("mit", "ADP"), ("por", "ADP"), ("con", "ADP"), ("pour", "ADP"),
    ("is", "VERB"), ("was", "VERB"), ("are", "VERB"), ("be", "VERB"), ("est", "VERB"), ("ist", "VERB"),
    ("es", "VERB"),
    ("not", "ADV"), ("pas", "ADV"), ("nicht", "ADV"), ("no", "ADV"),
    ("tion", "NOUN"), ("ment", "NOUN"), ("heit", "NOUN"), ("ung", "NOUN"), ("eau", "NOUN"),
    ("ble", "ADJ"), ("lich", "ADJ"), ("ous", "ADJ"),
]
POS_TAG_SET = ["NOUN", "ADV", "ADJ", "ADP", "VERB", "DET", "CCONJ"]

# ---- fixed values: gazetteer for entity-type counts ----
GAZETTEER = [
    ("he", "PER"), ("elle", "PER"), ("er", "PER"), ("she", "PER"), ("ich", "PER"),
    ("paris", "LOC"), ("ch", "LOC"), ("th", "LOC"), ("sch", "LOC"), ("eau", "LOC"),
    ("ing", "ORG"), ("ed", "ORG"), ("ung", "ORG"), ("ción", "ORG"),
]
ENTITY_TYPES = ["PER", "LOC", "ORG"]

# ---- fixed values: stopwords and lemma forms ----
STOPWORDS = [
    "the", "a", "an", "of", "to", "is", "it", "and",
    "le", "la", "les", "un", "une", "et",
    "der", "die", "das", "und", "ein",
    "el", "los", "las", "y", "se",
]
LEMMAS = [
    ("is", "be"), ("was", "be"), ("are", "be"), ("be", "be"),
    ("les", "le"), ("la", "le"), ("des", "de"), ("du", "de"),
    ("die", "der"), ("das", "der"), ("den", "der"), ("dem", "der"),
    ("los", "el"), ("las", "el"), ("del", "de"),
]

# ---- fixed values: namesakes (rule, entity stem or None for all, context word, stem of the surname, words apart) ----
NAMESAKES = [
    ("all_1", None, "fact", "th", 4), ("all_2", None, "que", "est", 2), ("the_1", "the", "from", "this", 8),
    ("the_2", "the", "by", "the", 3), ("of_1", "of", "with", "that", 8), ("de_1", "de", "les", "pour", 5),
    ("der_1", "der", "von", "die", 4), ("this_1", "this", "is", "no", 6),
]

# ---- fixed values: article rules (rules engine input) ----
# scope: 'sentence' (masked passage sentences) or 'doc' (whole text, lower-cased match).
# any_of / any_of2 / all_of / none_of are word-start (prefix) term lists; mask=True requires the mask
# token; whole=True asks for whole words; proximity = (a, b, max words between).
RULES = [
    dict(rule_id="head_of_state", scope="sentence", any_of=["with", "from", "this"], mask=True),
    dict(rule_id="prime_minister", scope="sentence", any_of=["pour", "dans", "avec", "sur"], mask=True),
    dict(rule_id="council", scope="sentence", any_of=["von", "mit", "sich"], mask=True),
    dict(rule_id="envoy_surname", scope="sentence",
         any_of=["los", "las", "del", "por", "con", "una", "para"], mask=True),
    dict(rule_id="speaker", scope="sentence", any_of=["nicht", "auf"], mask=True),
    dict(rule_id="state_council", scope="doc", any_of=["of the", "de la", "in der", "que el"]),
    dict(rule_id="engagement", scope="doc",
         any_of=["meeting", "forum", "citizens", "residents", "public", "hotline", "reception",
                 "appeal", "dialogue", "volunteers", "council", "assembly", "hearing"], whole=True),
    dict(rule_id="birthday", scope="doc", any_of=["birthday", "anniversaire", "geburtstag", "cumple"]),
    dict(rule_id="envoy_title", scope="doc", any_of=["by the", "par le"], mask=True),
    dict(rule_id="minister_federation", scope="sentence", all_of=["the", "of"], mask=True),
    dict(rule_id="party", scope="sentence", any_of=["and"], none_of=["for", "was"], mask=True),
    dict(rule_id="visit", scope="doc", any_of=["was", "est", "ist"], any_of2=["from", "par", "von"], whole=True),
    dict(rule_id="festival", scope="doc", any_of=["on the", "sur le"], any_of2=["this", "une"], whole=True),
    dict(rule_id="award", scope="doc", any_of=["able", "ble"], any_of2=["it is", "il est"], whole=True),
    dict(rule_id="speech", scope="doc", proximity=("the", "of", 6)),
    dict(rule_id="rating", scope="doc", any_of=["as", "als"], min_entities=5),
]
RULE_GROUPS = {
    "rule_sentence_cooccur": ["head_of_state", "prime_minister", "council", "envoy_surname", "speaker"],
    "rule_doc_any": ["state_council", "engagement", "birthday"],
    "rule_doc_cooccur": ["envoy_title"],
    "rule_all_of": ["minister_federation"],
    "rule_with_negation": ["party"],
    "rule_two_lists": ["visit", "festival", "award"],
    "rule_proximity": ["speech"],
    "rule_threshold": ["rating"],
}

# interview rule words (written with the precedence of the original expression, and as meant)
INTERVIEW_WORDS = dict(interview=["interview"], ask=["ask"], answer1=["answer"], asking=["asking"],
                       answering=["with"], question=["the"], talk=["said", "says", "dit", "sagt"])
# meeting rule: (name A or name B) and title over the whole text
MEETING_RULE = dict(names=["that", "this"], title=["with"])

# ---- fixed values: answers of the language-model stage ----
ANSWER_PHRASES = [
    ("direct_speech", "the"),
    ("indirect_speech", "de la"),
    ("no_speech", "nicht"),
    ("unclear", "que"),
]
ANSWER_RULES = [
    ("r1", ["the", "of"], []),
    ("r2", ["and", "the"], []),
    ("r3", ["de", "la"], []),
    ("r4", ["der", "die"], []),
    ("r5", ["que", "de"], []),
    ("r6", ["is", "the"], ["of"]),
    ("r7", ["le", "et"], []),
    ("r8", ["in", "und"], []),
]
ANSWER_REJECT = ["r3", "r4", "r5", "r7"]
ANSWER_ACCEPT = "r1"

# ---- fixed values: model-stage constants ----
PROMPT_MODEL = "chat-model"
PROMPT_SEED = 42
PROMPT_TEMPERATURE = 0.0
TOKEN_PRICE_PER_1K = 0.0010
PRESELECT_MIN_CHARS = 400
PRESELECT_MAX_PERSONS = 25
PRESELECT_MAX_OTHERS = 5

# ---- fixed values: keystroke stand-in mapping (events.event_type -> activity) ----
ACTIVITY_BY_EVENT = [
    ("click", "Input"),
    ("view", "Nonproduction"),
    ("purchase", "Remove/Cut"),
    ("signup", "Paste"),
    ("error", "Replace"),
]
# one known bad event and its corrected cells: (event_id, event_type, value)
EVENT_PATCHES = [(3, "click", 1.0), (17, "view", 2.5), (42, "signup", 0.5)]

# ---- fixed values: filings stand-in (lineitem flag -> fact name, status -> unit) ----
FACT_BY_FLAG = [("A", "Revenues"), ("N", "Assets"), ("R", "Liabilities")]
UNIT_BY_STATUS = [("F", "USD"), ("O", "shares")]
ANNUAL_FORM = "1-URGENT"
