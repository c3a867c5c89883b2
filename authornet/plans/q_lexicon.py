"""Registered queries for the lexicon engine.

L1-L3 work on a lexicon *derived from the data*: every distinct lower-cased
word of ``documents.text`` with two category ids given by a rule, so the
lexicon grows with the corpus.  L4-L10 match the fixed category lexicon
against the whole cleaned message texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import lexicon as L
from ..sources import fixtures as FX
from ..sources.tables import table
from . import sqltwin as S
from .authors import clean_messages, round_doubles
from .catalog import register

TOK = S.with_ctes(*S.BASE, S.TOKENS)
NAMES_SQL = "(SELECT i AS categories, name AS cat_name FROM (SELECT unnest(range(1, 69)) AS i, unnest([" + \
    ", ".join(S.q(n) for n in P.CATEGORY_NAMES) + "]) AS name))"
VOCAB_LEX_SQL = f"""vlex AS (
  SELECT DISTINCT w AS word, [CAST(length(w) % 68 + 1 AS INTEGER), CAST((length(w) * 7) % 68 + 1 AS INTEGER)] AS categories
  FROM (SELECT unnest(regexp_extract_all(lower(text), {S.q(P.WORD)})) AS w FROM documents) t),
vlong AS (SELECT DISTINCT word, CAST(unnest(categories) AS INTEGER) AS categories FROM vlex)"""


def vocab_lexicon(spark, sf):
    """Wide (word, categories) lexicon derived from the corpus vocabulary."""
    w = table(spark, sf, "documents").select(F.explode(X.words_array("text")).alias("word")).distinct()
    n = F.length("word")
    return w.select("word", F.array((n % 68 + 1).cast("int"), ((n * 7) % 68 + 1).cast("int")).alias("categories"))


def category_names(spark):
    return spark.createDataFrame(list(enumerate(P.CATEGORY_NAMES, start=1)), "categories int, cat_name string")


@register("l1_explode_lexicon", S.with_ctes(VOCAB_LEX_SQL) + "SELECT word, categories FROM vlong")
def q_l1(spark, sf):
    return L.explode_lexicon(vocab_lexicon(spark, sf)).distinct()


@register("l2_name_categories", S.with_ctes(VOCAB_LEX_SQL) + f"SELECT v.word, n.cat_name, v.categories FROM vlong v JOIN {NAMES_SQL} n ON v.categories = n.categories")
def q_l2(spark, sf):
    return L.name_categories(L.explode_lexicon(vocab_lexicon(spark, sf)).distinct(), category_names(spark))


@register("l3_sort_lexicon", S.with_ctes(VOCAB_LEX_SQL) + f"SELECT v.word, n.cat_name, v.categories FROM vlong v JOIN {NAMES_SQL} n ON v.categories = n.categories ORDER BY n.cat_name, v.word")
def q_l3(spark, sf):
    return L.sort_lexicon(L.name_categories(L.explode_lexicon(vocab_lexicon(spark, sf)).distinct(), category_names(spark)))


def _tokens(spark, sf):
    return L.tokenize(clean_messages(spark, sf))


@register("l4_filter_targets", TOK + f"SELECT tok, cat_name FROM vocab_hits WHERE cat_name IN ({', '.join(S.q(t) for t in P.LEXICON_TARGETS)})")
def q_l4(spark, sf):
    toks = _tokens(spark, sf)
    lex = FX.lexicon_df(spark)
    return L.filter_targets(L.match_exact(toks, lex).unionByName(L.match_prefix(toks, lex)))


@register("l5_tokenize", TOK + "SELECT UID_key, tok FROM toks")
def q_l5(spark, sf):
    return _tokens(spark, sf)


@register("l6_match_exact", TOK + "SELECT tok, cat_name FROM vocab_exact")
def q_l6(spark, sf):
    return L.match_exact(_tokens(spark, sf), FX.lexicon_df(spark))


@register("l7_match_prefix", TOK + "SELECT tok, cat_name FROM vocab_prefix")
def q_l7(spark, sf):
    return L.match_prefix(_tokens(spark, sf), FX.lexicon_df(spark))


LIWC_COLS = [f"liwc_{c}" for c in P.LEXICON_TARGETS]


@register("l8_lexicon_rates", S.rounded(["UID_key"] + LIWC_COLS, set(LIWC_COLS), TOK + "SELECT UID_key, " + ", ".join(LIWC_COLS) + " FROM liwc"))
def q_l8(spark, sf):
    df = L.lexicon_rates(clean_messages(spark, sf), FX.lexicon_df(spark), plan="inline")
    return round_doubles(df.select("UID_key", *LIWC_COLS))


@register("l9_lexicon_counts", TOK + "SELECT n.UID_key, " + ", ".join(
    f"CAST(coalesce(sum(c.hits) FILTER (WHERE c.cat_name = {S.q(t)}), 0) AS BIGINT) AS liwc_{t}" for t in P.LEXICON_TARGETS)
    + " FROM ntok n LEFT JOIN cat_hits c ON n.UID_key = c.UID_key GROUP BY n.UID_key")
def q_l9(spark, sf):
    df = L.lexicon_rates(clean_messages(spark, sf), FX.lexicon_df(spark), mode="count", plan="inline")
    return df.select("UID_key", *LIWC_COLS)


@register("l10_pivot_rates", S.rounded(["UID_key"] + LIWC_COLS, set(LIWC_COLS), TOK + "SELECT UID_key, " + ", ".join(LIWC_COLS) + " FROM liwc"))
def q_l10(spark, sf):
    return round_doubles(L.lexicon_rates(clean_messages(spark, sf), FX.lexicon_df(spark), plan="join", carry=["UID_key"]))
