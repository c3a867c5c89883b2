"""Per-message text expressions.

Every function returns a ``Column`` built from JVM-side built-ins, so a
projection that uses many of them stays inside one codegen stage and never
crosses into Python.  ``null`` and ``''`` both mean "no text".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count(col, pattern: str) -> Column:
    return F.regexp_count(_c(col), F.lit(P.java(pattern))).cast("bigint")


def _runs(col, char: str) -> Column:
    """Runs of one ASCII character; the scan is skipped where there is none."""
    c, zero = _c(col), F.lit(0).cast("bigint")
    return F.when(c.contains(char), _count(c, P.EXCLAMATION if char == "!" else P.QUESTION)).otherwise(zero)


def _ascii(c: Column) -> Column:
    """True for text of one-byte characters only; null for null."""
    return F.octet_length(c) == F.length(c)


def has_text(col) -> Column:
    """True when the value is neither null nor empty."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


# --- cleaning --------------------------------------------------------------

def remove_tags(col) -> Column:
    """Drop ``<a href="..">..</a>`` with its text, then bare tags."""
    c = _c(col)
    bare = F.regexp_replace(F.regexp_replace(c, P.java(P.A_TAG), ""), P.java(P.PLAIN_TAG), "")
    return F.when(c.contains("<"), bare).otherwise(c)  # most texts hold none


def remove_emojis(col) -> Column:
    """Delete runs of the emoji class."""
    c = _c(col)
    return F.when(_ascii(c), c).otherwise(F.regexp_replace(c, P.java(P.EMOJI_JAVA + "+"), ""))


def clean_text(col) -> Column:
    return remove_emojis(remove_tags(col))


def collapse_ws(col) -> Column:
    """P10: every white-space run becomes one space (no trimming)."""
    return F.regexp_replace(_c(col), P.java(P.WS_NO_BLANK), " ")


def strip_lower(col) -> Column:
    """Unicode strip + lower case; null stays null."""
    return F.lower(F.regexp_replace(_c(col), P.java(P.EDGE_WS), ""))


def chunk_text(col, n: int) -> Column:
    """The whole text as an array of pieces of at most ``n`` characters
    (a scorer's limit); '' is one empty piece, null stays null."""
    c = _c(col)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / n).cast("int") - 1, F.lit(0)))
    return F.when(c.isNotNull(), F.transform(starts, lambda k: F.substring(c, k * n + 1, F.lit(n))))


# --- counts ----------------------------------------------------------------

def sent_count(col) -> Column:
    """Pieces of a split on ``[.!?]+`` (a trailing empty piece counts)."""
    return F.when(has_text(col), _count(col, P.SENT_SEP) + 1).otherwise(F.lit(0).cast("bigint"))


def word_count(col) -> Column:
    """Unicode word runs."""
    return F.when(has_text(col), _count(col, P.WORD)).otherwise(F.lit(0).cast("bigint"))


def avg_sent_length(col) -> Column:
    """Words per sentence piece, 0 without sentences."""
    s = sent_count(col)
    return F.when(s > 0, word_count(col) / s).otherwise(F.lit(0.0))


def avg_word_length(col) -> Column:
    """T4: characters other than ' ' per word, 0 without words."""
    w = word_count(col)
    chars = F.length(F.replace(_c(col), F.lit(" "), F.lit("")))
    return F.when(w > 0, chars / w).otherwise(F.lit(0.0))


def exclamation_count(col) -> Column:
    """T5: runs of '!'."""
    return _runs(col, "!")


def question_count(col) -> Column:
    """Runs of '?'."""
    return _runs(col, "?")


def emoji_count(col) -> Column:
    """Emoji runs (apply to the uncleaned text)."""
    c = _c(col)
    return F.when(~_ascii(c), _count(c, P.EMOJI_JAVA + "+")).otherwise(F.lit(0).cast("bigint"))


def syllable_count(col) -> Column:
    """Vowel groups: the characters that go when the last one of each group does."""
    low = F.lower(_c(col))
    return F.coalesce((F.length(low) - F.length(F.regexp_replace(low, P.java(P.SYLLABLE_END), ""))).cast("bigint"), F.lit(0).cast("bigint"))


def flesch_de(col) -> Column:
    """German reading ease (Amstad):
    ``180 - words/sentences - 58.5 * syllables/words``.
    Sentences are the runs of ``[.!?]`` (at least one); null for blank text
    or text without words."""
    c = _c(col)
    words = _count(c, P.WORD)
    sentences = F.greatest(_count(c, P.SENT_SEP), F.lit(1).cast("bigint"))
    score = F.lit(180.0) - words / sentences - F.lit(58.5) * syllable_count(c) / words
    # blank text has no words, so one test covers both cases
    return F.when(c.isNull() | (words == 0), F.lit(None).cast("double")).otherwise(score)


def flesch_class(score) -> Column:
    """Half-open bands, everything else (null included) 'unclassified'."""
    s = _c(score)
    expr = None
    for lo, hi, label in P.FLESCH_BANDS:
        cond = (s >= lo) & (s < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(P.FLESCH_OTHER))


def words_array(col) -> Column:
    """Lower-cased Unicode word tokens (POS and polarity lookups)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(P.java(P.WORD)), 0)


def ws_tokens(col) -> Column:
    """Lower-cased whitespace tokens, punctuation kept; [] for no text."""
    blank = F.lower(_c(col))
    for sep in "\t\n":
        blank = F.replace(blank, F.lit(sep), F.lit(" "))
    # split at every blank: the empty pieces inside and around runs go
    return F.coalesce(F.array_remove(F.split(blank, " "), ""), F.array().cast("array<string>"))
