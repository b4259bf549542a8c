"""Small fixed tables: stop words, tag look-ups, keyword sets, gazetteer.

Every table here is a handful of rows and never grows with the data, so the
operators join them with ``broadcast`` (size bound = the literal lists below).
The same lists render as SQL ``VALUES`` so the DuckDB oracle can reproduce the
exact look-ups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay as written for results to match).
# ---------------------------------------------------------------------------

# English stop words as distributed with NLTK (179 words, NLTK order).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it",
    "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't",
    "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma",
    "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
    "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't",
    "won", "won't", "wouldn", "wouldn't",
]

# Light verbs, verb and noun tag sets of the psycholinguistic features.
LIGHT_VERBS = ["be", "have", "come", "go", "give", "take", "make", "do", "get", "move", "put"]
VERB_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]
NOUN_TAGS = ["NN", "NNS", "NNP", "NNPS"]
PSYCH_MEASURES = ["familiarity", "concreteness", "imagability", "aoa"]

# Information-unit keyword sets (extended set of the picture-description task).
INFO_UNITS = {
    "Boy": ["boy", "son", "brother", "male child"],
    "Girl": ["girl", "daughter", "sister", "female child"],
    "Woman": ["woman", "mom", "mother", "lady", "parent", "female", "adult", "grownup"],
    "Kitchen": ["kitchen", "room"],
    "Exterior": ["exterior", "outside", "garden", "yard", "outdoors", "backyard", "driveway", "path", "tree", "bush"],
    "Cookie": ["cookie", "biscuit", "cake", "treat"],
    "Jar": ["jar", "container", "crock", "pot"],
    "Stool": ["stool", "seat", "chair", "ladder"],
    "Sink": ["sink", "basin", "washbasin", "washbowl", "washstand", "tap"],
    "Plate": ["plate"],
    "Dishcloth": ["dishcloth", "dishrag", "rag", "cloth", "napkin", "towel"],
    "Water": ["water", "dishwater", "liquid"],
    "Window": ["window", "frame", "glass"],
    "Cupboard": ["cupboard", "closet", "shelf"],
    "Dishes": ["dish", "dishes", "cup", "cups", "counter"],
    "Curtains": ["curtain", "curtains", "drape", "drapes", "drapery", "drapery", "blind", "blinds", "screen", "screens"],
}
ACTION_WORDS = {
    "Steal": ["take", "steal", "taking", "stealing"],
    "Fall": ["fall", "falling", "slip", "slipping"],
    "Wash": ["wash", "dry", "clean", "washing", "drying", "cleaning"],
    "Overflow": ["overflow", "spill", "overflowing", "spilling"],
}
# Action units: (name, subject sets, verb set).
ACTION_UNITS = [
    ("BoyTaking", ["Boy"], "Steal"),
    ("StoolFalling", ["Boy", "Stool"], "Fall"),
    ("WomanDryingWashing", ["Woman", "Plate"], "Wash"),
    ("WaterOverflowing", ["Water"], "Overflow"),
]
# Picture regions: split -> region -> member sets (duplicates kept: the
# coverage denominator is the list length).
REGIONS = {
    "halves": {
        "leftside": ["Boy", "Girl", "Cookie", "Jar", "Stool", "Cupboard", "Steal", "Fall", "Kitchen"],
        "rightside": ["Woman", "Exterior", "Sink", "Plate", "Dishcloth", "Water", "Window", "Dishes",
                      "Curtains", "Wash", "Overflow", "Cupboard", "Kitchen"],
    },
    "strips": {
        "farleft": ["Girl", "Cookie", "Jar", "Stool", "Cupboard", "Steal", "Kitchen", "Cupboard"],
        "centerleft": ["Boy", "Cookie", "Stool", "Steal", "Fall", "Kitchen", "Cupboard"],
        "farright": ["Woman", "Exterior", "Sink", "Plate", "Dishcloth", "Water", "Window", "Dishes",
                     "Curtains", "Wash", "Overflow", "Kitchen", "Cupboard"],
        "centerright": ["Exterior", "Window", "Dishes", "Curtains", "Kitchen", "Cupboard"],
    },
    "quadrants": {
        "NW": ["Girl", "Cookie", "Jar", "Cupboard", "Steal", "Boy", "Cookie", "Kitchen"],
        "NE": ["Woman", "Exterior", "Plate", "Dishcloth", "Wash", "Window", "Curtains", "Kitchen"],
        "SE": ["Woman", "Sink", "Water", "Dishes", "Overflow", "Cupboard", "Kitchen"],
        "SW": ["Girl", "Stool", "Fall", "Cupboard", "Kitchen"],
    },
}

# Closed-class Penn tag look-up (the tagger is replaced by this table plus the
# suffix rules in ``functions.text.fallback_tag``).
CLOSED_CLASS_TAGS = [
    ("the", "DT"), ("a", "DT"), ("an", "DT"), ("this", "DT"), ("that", "DT"), ("these", "DT"),
    ("those", "DT"), ("every", "DT"), ("each", "DT"), ("some", "DT"), ("any", "DT"), ("no", "DT"),
    ("another", "DT"), ("either", "DT"), ("neither", "DT"), ("all", "PDT"), ("both", "PDT"),
    ("half", "PDT"), ("i", "PRP"), ("me", "PRP"), ("you", "PRP"), ("he", "PRP"), ("him", "PRP"),
    ("she", "PRP"), ("her", "PRP"), ("it", "PRP"), ("we", "PRP"), ("us", "PRP"), ("they", "PRP"),
    ("them", "PRP"), ("myself", "PRP"), ("yourself", "PRP"), ("himself", "PRP"),
    ("herself", "PRP"), ("itself", "PRP"), ("ourselves", "PRP"), ("themselves", "PRP"),
    ("my", "PRP$"), ("your", "PRP$"), ("his", "PRP$"), ("its", "PRP$"), ("our", "PRP$"),
    ("their", "PRP$"), ("who", "WP"), ("whom", "WP"), ("what", "WP"), ("whose", "WP$"),
    ("which", "WDT"), ("when", "WRB"), ("where", "WRB"), ("why", "WRB"), ("how", "WRB"),
    ("of", "IN"), ("in", "IN"), ("on", "IN"), ("at", "IN"), ("by", "IN"), ("for", "IN"),
    ("with", "IN"), ("about", "IN"), ("from", "IN"), ("into", "IN"), ("over", "IN"),
    ("under", "IN"), ("after", "IN"), ("before", "IN"), ("between", "IN"), ("through", "IN"),
    ("during", "IN"), ("without", "IN"), ("against", "IN"), ("since", "IN"), ("because", "IN"),
    ("if", "IN"), ("while", "IN"), ("although", "IN"), ("though", "IN"), ("unless", "IN"),
    ("whether", "IN"), ("as", "IN"), ("than", "IN"), ("upon", "IN"), ("within", "IN"),
    ("across", "IN"), ("behind", "IN"), ("near", "IN"), ("to", "TO"), ("and", "CC"),
    ("or", "CC"), ("but", "CC"), ("nor", "CC"), ("can", "MD"), ("could", "MD"), ("will", "MD"),
    ("would", "MD"), ("shall", "MD"), ("should", "MD"), ("may", "MD"), ("might", "MD"),
    ("must", "MD"), ("is", "VBZ"), ("are", "VBP"), ("am", "VBP"), ("was", "VBD"),
    ("were", "VBD"), ("be", "VB"), ("been", "VBN"), ("being", "VBG"), ("has", "VBZ"),
    ("have", "VBP"), ("had", "VBD"), ("having", "VBG"), ("do", "VBP"), ("does", "VBZ"),
    ("did", "VBD"), ("doing", "VBG"), ("done", "VBN"), ("go", "VB"), ("goes", "VBZ"),
    ("went", "VBD"), ("gone", "VBN"), ("take", "VB"), ("takes", "VBZ"), ("took", "VBD"),
    ("taken", "VBN"), ("come", "VB"), ("comes", "VBZ"), ("came", "VBD"), ("make", "VB"),
    ("makes", "VBZ"), ("made", "VBD"), ("give", "VB"), ("gives", "VBZ"), ("gave", "VBD"),
    ("given", "VBN"), ("get", "VB"), ("gets", "VBZ"), ("got", "VBD"), ("put", "VB"),
    ("move", "VB"), ("see", "VB"), ("saw", "VBD"), ("seen", "VBN"), ("fall", "VB"),
    ("fell", "VBD"), ("steal", "VB"), ("stole", "VBD"), ("wash", "VB"), ("dry", "VB"),
    ("spill", "VB"), ("overflow", "VB"), ("not", "RB"), ("very", "RB"), ("also", "RB"),
    ("just", "RB"), ("only", "RB"), ("too", "RB"), ("here", "RB"), ("now", "RB"),
    ("then", "RB"), ("never", "RB"), ("always", "RB"), ("often", "RB"), ("again", "RB"),
    ("so", "RB"), ("more", "RBR"), ("most", "RBS"), ("there", "EX"), ("um", "UH"),
    ("uh", "UH"), ("oh", "UH"), ("ah", "UH"), ("yeah", "UH"), ("yes", "UH"), ("hmm", "UH"),
    ("well", "UH"), ("one", "CD"), ("two", "CD"), ("three", "CD"), ("four", "CD"),
    ("five", "CD"), ("six", "CD"), ("seven", "CD"), ("eight", "CD"), ("nine", "CD"),
    ("ten", "CD"), ("first", "JJ"), ("second", "JJ"), ("third", "JJ"), ("up", "RP"),
]

# Irregular lemmas (everything else is lemmatised by the suffix rule).
IRREGULAR_LEMMAS = [
    ("is", "be"), ("are", "be"), ("am", "be"), ("was", "be"), ("were", "be"), ("been", "be"),
    ("being", "be"), ("has", "have"), ("had", "have"), ("having", "have"), ("does", "do"),
    ("did", "do"), ("done", "do"), ("doing", "do"), ("goes", "go"), ("went", "go"),
    ("gone", "go"), ("took", "take"), ("taken", "take"), ("takes", "take"), ("came", "come"),
    ("comes", "come"), ("made", "make"), ("makes", "make"), ("gave", "give"), ("given", "give"),
    ("gives", "give"), ("got", "get"), ("gets", "get"), ("saw", "see"), ("seen", "see"),
    ("fell", "fall"), ("stole", "steal"), ("children", "child"), ("men", "man"),
    ("women", "woman"), ("feet", "foot"), ("mice", "mouse"), ("dishes", "dish"),
]

# Penn tag -> universal tag (the 17 universal tags of the feature table).
UNIVERSAL_TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART",
                  "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
PENN_TO_UNIVERSAL = [
    ("CC", "CCONJ"), ("CD", "NUM"), ("DT", "DET"), ("EX", "PRON"), ("FW", "X"), ("IN", "ADP"),
    ("JJ", "ADJ"), ("JJR", "ADJ"), ("JJS", "ADJ"), ("LS", "X"), ("MD", "AUX"), ("NN", "NOUN"),
    ("NNS", "NOUN"), ("NNP", "PROPN"), ("NNPS", "PROPN"), ("PDT", "DET"), ("POS", "PART"),
    ("PRP", "PRON"), ("PRP$", "PRON"), ("RB", "ADV"), ("RBR", "ADV"), ("RBS", "ADV"),
    ("RP", "ADP"), ("SYM", "SYM"), ("TO", "PART"), ("UH", "INTJ"), ("VB", "VERB"),
    ("VBD", "VERB"), ("VBG", "VERB"), ("VBN", "VERB"), ("VBP", "VERB"), ("VBZ", "VERB"),
    ("WDT", "DET"), ("WP", "PRON"), ("WP$", "PRON"), ("WRB", "ADV"), (".", "PUNCT"),
    (",", "PUNCT"), (":", "PUNCT"),
]
# Subordinating conjunctions (IN words mapped to SCONJ instead of ADP) and
# auxiliary lemmas (verb tags mapped to AUX instead of VERB).
SUBORDINATORS = ["because", "if", "while", "although", "though", "unless", "whether", "since"]
AUX_LEMMAS = ["be", "have", "do"]

# Entity labels and the gazetteer that stands in for a model recogniser.
ENTITY_LABELS = ["PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT",
                 "WORK_OF_ART", "LAW", "LANGUAGE", "DATE", "TIME", "PERCENT", "MONEY",
                 "QUANTITY", "ORDINAL", "CARDINAL"]
GAZETTEER = [
    ("monday", "DATE"), ("tuesday", "DATE"), ("wednesday", "DATE"), ("thursday", "DATE"),
    ("friday", "DATE"), ("saturday", "DATE"), ("sunday", "DATE"), ("january", "DATE"),
    ("february", "DATE"), ("march", "DATE"), ("april", "DATE"), ("june", "DATE"),
    ("july", "DATE"), ("august", "DATE"), ("september", "DATE"), ("october", "DATE"),
    ("november", "DATE"), ("december", "DATE"), ("today", "DATE"), ("yesterday", "DATE"),
    ("tomorrow", "DATE"), ("last week", "DATE"), ("next week", "DATE"), ("last year", "DATE"),
    ("this morning", "TIME"), ("tonight", "TIME"), ("noon", "TIME"), ("midnight", "TIME"),
    ("english", "LANGUAGE"), ("french", "NORP"), ("german", "NORP"), ("spanish", "NORP"),
    ("american", "NORP"), ("european", "NORP"), ("france", "GPE"), ("germany", "GPE"),
    ("spain", "GPE"), ("england", "GPE"), ("paris", "GPE"), ("london", "GPE"),
    ("berlin", "GPE"), ("madrid", "GPE"), ("new york", "GPE"), ("united states", "GPE"),
    ("united kingdom", "GPE"), ("new york city", "GPE"), ("europe", "LOC"), ("atlantic", "LOC"),
    ("first", "ORDINAL"), ("second", "ORDINAL"), ("third", "ORDINAL"), ("fourth", "ORDINAL"),
    ("fifth", "ORDINAL"), ("one", "CARDINAL"), ("two", "CARDINAL"), ("three", "CARDINAL"),
    ("four", "CARDINAL"), ("five", "CARDINAL"), ("six", "CARDINAL"), ("seven", "CARDINAL"),
    ("eight", "CARDINAL"), ("nine", "CARDINAL"), ("ten", "CARDINAL"), ("hundred", "CARDINAL"),
    ("thousand", "CARDINAL"), ("million", "CARDINAL"), ("percent", "PERCENT"),
    ("dollars", "MONEY"), ("euros", "MONEY"), ("christmas", "EVENT"), ("easter", "EVENT"),
    ("world war", "EVENT"), ("bible", "WORK_OF_ART"), ("google", "ORG"), ("microsoft", "ORG"),
    ("united nations", "ORG"), ("john", "PERSON"), ("mary", "PERSON"), ("peter", "PERSON"),
]

# Auxiliary dependency relations (F07) and the named parent -> child rules
# (F06: one child label, or a set of child labels that must all be present).
AUX_DEPENDENCIES = ["auxpass", "cop", "aux", "xcomp"]
TREE_RULES = [
    ("NP_to_PRP", "NP", ["PRP"]),
    ("ADVP_to_RB", "ADVP", ["RB"]),
    ("NP_to_DT_NN", "NP", ["DT", "NN"]),
    ("VP_to_VBG", "VP", ["VBG"]),
    ("VP_to_VBG_PP", "VP", ["VBG", "PP"]),
    ("VP_to_VBD_NP", "VP", ["VBD", "NP"]),
    ("INTJ_to_UH", "INTJ", ["UH"]),
    ("ROOT_to_FRAG", "ROOT", ["FRAG"]),
]
# Constituent labels counted by the CFG features.
CFG_LABELS = ["ADJP", "ADVP", "CONJP", "FRAG", "INTJ", "LST", "NAC", "NP", "NX", "PP", "PRN",
              "PRT", "QP", "RRC", "S", "SBAR", "SBARQ", "SINV", "SQ", "UCP", "VP"]


# ---------------------------------------------------------------------------
# Table builders (Spark side) and VALUES renderers (oracle side).
# ---------------------------------------------------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_sql(rows, columns) -> str:
    """Render rows as a SQL derived table: ``(VALUES ...) AS t(cols)``."""
    body = ", ".join("(" + ", ".join(sql_str(v) if isinstance(v, str) else repr(v) for v in r) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def table(spark: SparkSession, rows, columns) -> DataFrame:
    """A small literal table, marked for broadcast (its size is the list above)."""
    return F.broadcast(spark.createDataFrame(list(rows), list(columns)))


def stop_words_df(spark):
    return table(spark, [(w,) for w in dict.fromkeys(STOP_WORDS)], ["word"])


def keyword_rows():
    """(word, unit) for every information unit and action word set."""
    out = []
    for unit, words in {**INFO_UNITS, **ACTION_WORDS}.items():
        for w in dict.fromkeys(words):
            out.append((w, unit))
    return out


def region_rows():
    """(split, region, word, set_size): member words per picture region.

    ``set_size`` is the length of the concatenated list with duplicates, the
    denominator of the coverage feature.
    """
    sets = {**INFO_UNITS, **ACTION_WORDS}
    out = []
    for split, regions in REGIONS.items():
        for region, members in regions.items():
            words = [w for m in members for w in sets[m]]
            for w in dict.fromkeys(words):
                out.append((split, region, w, len(words)))
    return out


def side_rows():
    """(word, side) with a word on both sides counted as right."""
    left = [w for m in REGIONS["halves"]["leftside"] for w in {**INFO_UNITS, **ACTION_WORDS}[m]]
    right = [w for m in REGIONS["halves"]["rightside"] for w in {**INFO_UNITS, **ACTION_WORDS}[m]]
    sides = {w: "left" for w in left}
    sides.update({w: "right" for w in right})
    return sorted(sides.items())
