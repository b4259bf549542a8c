"""Column expressions for transcript text (all JVM-side, codegen-friendly).

No Python UDF appears here: tokenising, cleaning, tagging fallbacks and
stemming are regular expressions and CASE expressions, so they run inside
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed rules (shared with the SQL oracle, see SURVEY §7.4).
TOKEN_RE = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
WORD_RE = r"^\p{L}+$"
# Terms of the pairwise TF-IDF: runs of two or more word characters.
TERM_RE = r"[\p{L}\p{N}_]{2,}"
PUNCT_RE = r"[!-/:-@\[-`{-~]"  # ASCII punctuation, as string.punctuation
NON_ASCII_RE = r"[^\x00-\x7F]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Token array (letters runs, digit runs, single other characters)."""
    return F.regexp_extract_all(col(text), F.lit(TOKEN_RE), 0)


def spaced_tokens(text) -> Column:
    """``tokens`` of a column of texts that mostly hold letters and spaces
    only, as without punctuation: those are split at the spaces, without a
    match a token. (An end of input: ``$`` allows a line end, a token, behind it.)"""
    return F.when(col(text).rlike(r"^[\p{L} ]*\z"), F.array_remove(F.split(col(text), " "), "")).otherwise(tokens(text))


def is_word(tok) -> Column:
    """B12 predicate: purely alphabetic token."""
    return col(tok).rlike(WORD_RE)


def is_punct_token(tok) -> Column:
    """B11 predicate: a one-character token that is neither letter nor digit.
    Longer ones (the expression allows a line end behind it) need no match."""
    return (F.length(col(tok)) <= 3) & col(tok).rlike(r"^[^\p{L}\p{N}]$")


def remove_non_ascii(text) -> Column:
    """Drop every code point >= 128."""
    return F.regexp_replace(col(text), NON_ASCII_RE, "")


# The ordered removal chain of the transcript cleaner. Each pair is
# (pattern, replacement) and the order is significant.
CLEAN_STEPS = [
    (r"\t", ""),
    (r"\n", " "),
    (r"~", " "),
    (r"[0-9]+", ""),
    (r"\[_\]", ""),
    (r"f@l", ""),
    (r"\|", ""),
    (r"_", ""),
    (r"nuk", ""),
    (r"x@n", ""),
    (r'\+"/', ""),
    (r"\+<", ""),
    (r"\+/", ""),
    ("‡", ""),
    (r"[\x00-\x1F]+", ""),
    (r"@", ""),
    (r"xxx", ""),
    (r"\[\+ exc\]", ""),
]


def clean_text(text) -> Column:
    out = col(text)
    for pat, rep in CLEAN_STEPS:
        out = F.regexp_replace(out, pat, rep)
    return out


def merge_apostrophes(text) -> Column:
    """Glue a whitespace token containing an apostrophe to the previous
    token, then drop apostrophes (``do n't`` -> `` dont``). Words are
    re-joined with single spaces and a leading space, as the cleaner does."""
    t = F.trim(col(text))
    spaced = F.concat(F.lit(" "), F.regexp_replace(t, r"\s+", " "))
    glued = F.regexp_replace(spaced, r" (?=[^ ]*')", "")
    return F.when(t == "", F.lit("")).otherwise(F.translate(glued, "'", ""))


def sentence_count(text) -> Column:
    """Number of non-blank pieces between sentence terminators."""
    return F.size(F.filter(F.split(col(text), r"[.!?]+"), lambda s: F.trim(s) != ""))


def light_stem(word) -> Column:
    """B14 stand-in for a stemmer: strip one regular inflection suffix."""
    w = col(word)
    n = F.length(w)
    return (F.when(w.endswith("ing") & (n > 4), w.substr(F.lit(1), n - 3))
            .when(w.endswith("ed") & (n > 3), w.substr(F.lit(1), n - 2))
            .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), w.substr(F.lit(1), n - 1))
            .otherwise(w))


def fallback_tag(tok, lw=None) -> Column:
    """Penn tag for tokens missing from the closed-class table.

    Word tokens (the vast majority) are tested first, so they pay for one
    regular expression; the digit and punctuation rules only run for the
    rest. The result equals the flat rule order CD, ., ,, :, SYM, FW, suffixes.
    ``lw`` is a column that holds the token in lower case: without it every
    rule that a token reaches makes it anew.
    """
    t = col(tok)
    lw = F.lower(t) if lw is None else col(lw)
    n = F.length(lw)
    word = (F.when(F.octet_length(t) > F.length(t), "FW")  # NON_ASCII_RE
            .when(lw.endswith("ing") & (n > 4), "VBG")
            .when(lw.endswith("ed") & (n > 3), "VBD")
            .when(lw.endswith("ly") & (n > 3), "RB")
            .when((lw.endswith("ous") | lw.endswith("ful") | lw.endswith("ive")
                   | lw.endswith("able")) & (n > 4), "JJ")
            .when(lw.endswith("s") & ~lw.endswith("ss") & (n > 3), "NNS")
            .otherwise("NN"))
    other = (F.when(t.rlike(r"^\p{N}+$"), "CD")
             .when(t.rlike(r"^[.!?]$"), ".")
             .when(t == ",", ",")
             .when(t.rlike(r"^[:;]$"), ":")
             .otherwise("SYM"))
    return F.when(t.rlike(WORD_RE), word).otherwise(other)


def rule_lemma(lw, tag) -> Column:
    """Lemma for words not in the irregular table."""
    w, t = col(lw), col(tag)
    n = F.length(w)
    return (F.when((t == "NNS") & w.endswith("s"), w.substr(F.lit(1), n - 1))
            .when((t == "VBG") & w.endswith("ing"), w.substr(F.lit(1), n - 3))
            .when((t == "VBD") & w.endswith("ed"), w.substr(F.lit(1), n - 2))
            .otherwise(w))


def round6(c) -> Column:
    return F.round(col(c).cast("double"), 6)


def safe_div(a, b) -> Column:
    """Division that yields null for a zero or null denominator (ANSI-safe)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def attach_scalar(df, one_row):
    """Attach the columns of a one-row aggregate to every row: an equi-join on
    a constant key against a broadcast side whose size is exactly one row."""
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
