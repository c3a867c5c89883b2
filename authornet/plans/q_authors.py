"""Registered queries for the author tables and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import lexicon as L
from ..operators import textfeat as TF
from ..sources import fixtures as FX
from . import sqltwin as S
from .authors import author_table, clean_messages, message_features, round_doubles, toxicity_scores
from .catalog import register

FULL = S.with_ctes(*S.ALL_FEATURES)
AUTHOR_DOUBLES = set(S.MEANS) | set(S.SHARES) | {"own_message", "forwarded_message", "action_quotient",
                                                  "sentiment_quotient", "toxicity"}
AG_COLS = (["noun_count", "verb_count", "adj_count"] + S.SHARES + [c for c in S.MEANS] +
           ["own_message", "forwarded_message", "total_message_count", "was_forwarded", "own_message_count",
            "forwarded_message_count", "action_quotient", "sentiment_quotient", "avg_flesch_reading_ease_class"])
A2_COLS = ["author"] + A.FEATURES_30 + ["avg_flesch_reading_ease_class"]


def _author_sql(cols, digits: int | None = 6) -> str:
    inner = FULL + ", " + S.author_ctes(["author"]) + ", " + S.TOXICITY + """
SELECT ag.*, CASE WHEN ag.own_message = 1 THEN tox.tox END AS toxicity
FROM ag LEFT JOIN tox ON tox.author = ag.author"""
    return S.rounded(cols, AUTHOR_DOUBLES if digits else (), inner)


def _author_slice(cols):
    def fn(spark, sf):
        return round_doubles(author_table(spark, sf).select(*cols))
    return fn


register("a2_author_features", _author_sql(A2_COLS))(_author_slice(A2_COLS))
for _name, _cols in [
        ("a6_message_ratios", ["author", "own_message", "forwarded_message", "own_message_count",
                               "forwarded_message_count", "total_message_count"]),
        ("a7_share_of_own", ["author"] + S.SHARES),
        ("a8_action_quotient", ["author", "verb_count", "adj_count", "action_quotient"]),
        ("a9_sentiment_quotient", ["author", "sentiment_quotient"]),
        ("a10_author_flesch", ["author", "flesch_reading_ease", "avg_flesch_reading_ease_class"]),
        ("t12_toxicity", ["author", "own_message", "toxicity"])]:
    register(_name, _author_sql(_cols))(_author_slice(_cols))


def _keyed_sql(keys):
    cols = list(keys) + AG_COLS
    return S.rounded(cols, AUTHOR_DOUBLES, FULL + ", " + S.author_ctes(keys) + " SELECT * FROM ag")


def _keyed(keys):
    def fn(spark, sf):
        feats = message_features(spark, sf, full=True)
        return round_doubles(A.post_features(A.aggregate_features(feats, keys)).select(*keys, *AG_COLS))
    return fn


register("a1_author_group_full", _keyed_sql(["author", "group_name"]))(_keyed(["author", "group_name"]))
register("a3_author_date", _keyed_sql(["author", "date"]))(_keyed(["author", "date"]))


@register("a4_message_counts", S.with_ctes(*S.BASE) + """
SELECT author, group_name, CAST(sum(own_message) AS BIGINT) AS own_message,
  CAST(sum(forwarded_message) AS BIGINT) AS forwarded_message, CAST(count(UID_key) AS BIGINT) AS total_message_count
FROM clean WHERE author IS NOT NULL AND group_name IS NOT NULL GROUP BY author, group_name""")
def q_a4(spark, sf):
    return A.message_counts(clean_messages(spark, sf))


PART_ROWS = 8  # small, so that authors have several parts in the smallest tables as well


def _texts_sql(keys) -> str:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    joined = ", ".join(f"coalesce(string_agg({c}, ' ' ORDER BY UID_key) FILTER (WHERE {S.has_text(c)}), '') AS {c}"
                       for c in ("final_message", "final_message_string"))
    return f"""txt AS (SELECT {k}, part, {joined} FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY {k} ORDER BY UID_key) - 1) // {PART_ROWS} AS BIGINT) AS part
  FROM clean WHERE {notnull} AND ({S.has_text('final_message')} OR {S.has_text('final_message_string')})) t GROUP BY {k}, part)"""


def _texts(clean, keys):
    return A.join_texts(clean, keys, ("final_message", "final_message_string"), part_rows=PART_ROWS)


@register("a5_join_texts", S.with_ctes(*S.BASE, _texts_sql(["author"])) + "SELECT * FROM txt")
def q_a5(spark, sf):
    return _texts(clean_messages(spark, sf), ["author"])


@register("a5_join_texts_string_key", S.with_ctes(*S.BASE, _texts_sql(["author"])) + "SELECT * FROM txt")
def q_a5s(spark, sf):
    """The same parts with the order given as text (padded numbers)."""
    clean = clean_messages(spark, sf).withColumn("UID_key", F.lpad(F.col("UID_key").cast("string"), 20, "0"))
    return _texts(clean, ["author"])


def _with_texts_sql(keys) -> str:
    on = " AND ".join(f"t.{c} = g.{c}" for c in keys)
    inner = FULL + ", " + S.author_ctes(keys) + ", " + _texts_sql(keys) + f"""
SELECT g.*, t.part, t.final_message, t.final_message_string FROM ag g LEFT JOIN txt t ON {on}"""
    return S.rounded(list(keys) + AG_COLS + ["part", "final_message", "final_message_string"], AUTHOR_DOUBLES, inner)


def _with_texts(keys):
    def fn(spark, sf):
        feats = message_features(spark, sf, full=True)
        agg = A.post_features(A.aggregate_features(feats, keys)).select(*keys, *AG_COLS)
        return round_doubles(A.attach_texts(agg, _texts(clean_messages(spark, sf), keys), keys))
    return fn


register("a1_author_group_texts", _with_texts_sql(["author", "group_name"]))(_with_texts(["author", "group_name"]))
register("a2_author_texts", _with_texts_sql(["author"]))(_with_texts(["author"]))


@register("t12_text_toxicity", S.rounded(["author", "own_message", "toxicity"], {"own_message", "toxicity"}, FULL + ", " + S.author_ctes(["author"]) + ", " + _texts_sql(["author"]) + f""",
pc AS (SELECT author, final_message_string AS x, length(final_message_string) AS n,
         unnest(range(CAST(greatest(ceil(length(final_message_string) / 500.0), 1) AS BIGINT))) AS p FROM txt),
sc AS (SELECT author, least(500, n - 500 * p) AS size,
         CAST(length(substring(x, CAST(500 * p + 1 AS BIGINT), 500)) - length(replace(substring(x, CAST(500 * p + 1 AS BIGINT), 500), '!', '')) AS DOUBLE) AS bangs FROM pc),
tx AS (SELECT author, sum(bangs) / greatest(sum(size), 1) AS t FROM sc GROUP BY author)
SELECT g.author, g.own_message, CASE WHEN g.own_message = 1 THEN tx.t END AS toxicity FROM ag g LEFT JOIN tx ON tx.author = g.author"""))
def q_t12t(spark, sf):
    """Toxicity of an author's whole text where every message is their own: the
    parts go to the batch scorer in pieces, their scores are combined by length.
    A part without a score ends the query: a null means that not all messages are their own."""
    clean = clean_messages(spark, sf)
    agg = A.message_ratios(A.message_counts(clean, ["author"]))
    scored = TF.score_batches(_texts(clean, ["author"]).select("author", "final_message_string"), "final_message_string",
                              _shout_scorer, out="score", max_chars=500, on_failure="raise")
    size = F.length("final_message_string")
    own = scored.groupBy("author").agg((F.sum(F.col("score") * size) / F.greatest(F.sum(size), F.lit(1))).alias("toxicity"))
    return round_doubles(TF.toxicity(agg, own).select("author", "own_message", "toxicity"))


def _shout_scorer(s):
    """Deterministic stand-in scorer: exclamation marks per character."""
    return s.str.count("!") / s.str.len().clip(lower=1)


# --- J1-J5 -----------------------------------------------------------------------
@register("j1_merge_features", S.rounded(["UID_key", "word_count"] + [f"liwc_{c}" for c in ["Affect", "I", "Other", "We", "You"]],
                                         {f"liwc_{c}" for c in ["Affect", "I", "Other", "We", "You"]},
                                         FULL + "SELECT f.UID_key, f.word_count, l.* EXCLUDE (UID_key, n) FROM feat1 f FULL OUTER JOIN liwc l ON f.UID_key = l.UID_key"))
def q_j1(spark, sf):
    counted = TF.count_features(clean_messages(spark, sf))
    both = L.lexicon_rates(counted, FX.lexicon_df(spark), plan="join", carry=["UID_key", "word_count"])
    return round_doubles(A.merge_features(both.select("UID_key", "word_count"), both.drop("word_count"), "UID_key"))


MERGE_COLS = ["noun_count", "verb_count", "adj_count", "positive_sentiment", "negative_sentiment",
              "neutral_sentiment", "channel_messages", "group_messages"] + S.MEANS + \
    ["own_message", "forwarded_message", "total_message_count"]


def _merge_sql(keys):
    k = ", ".join(keys)
    on = " AND ".join(f"l.{c} = c.{c}" for c in keys)
    coal = ", ".join(f"coalesce(l.{c}, c.{c}) AS {c}" for c in keys)
    inner = FULL + ", " + S.author_ctes(keys) + f"""
SELECT {coal}, l.* EXCLUDE ({k}), c.own_n AS own_message, c.fwd_n AS forwarded_message, c.total_message_count
FROM ag_ling l FULL OUTER JOIN ag_cnt c ON {on}"""
    return S.rounded(list(keys) + MERGE_COLS, set(S.MEANS), inner)


def _merge(keys):
    def fn(spark, sf):
        feats = message_features(spark, sf, full=True)
        merged = A.merge_counts(A.linguistic(feats, keys), A.message_counts(feats, keys), keys)
        return round_doubles(merged.select(*keys, *MERGE_COLS))
    return fn


register("j2_merge_counts", _merge_sql(["author", "group_name"]))(_merge(["author", "group_name"]))
register("j3_merge_counts_author", _merge_sql(["author"]))(_merge(["author"]))
register("j4_merge_counts_date", _merge_sql(["author", "date"]))(_merge(["author", "date"]))


@register("j5_was_forwarded", S.with_ctes(*S.BASE) + """, cnt AS (
  SELECT author, group_name FROM clean WHERE author IS NOT NULL GROUP BY author, group_name),
fw AS (SELECT fwd_author, group_name, CAST(count(*) AS BIGINT) AS n FROM clean WHERE fwd_author IS NOT NULL GROUP BY 1, 2)
SELECT c.author, c.group_name, coalesce(fw.n, 0) AS was_forwarded
FROM cnt c LEFT JOIN fw ON fw.fwd_author = c.author AND fw.group_name = c.group_name""")
def q_j5(spark, sf):
    clean = clean_messages(spark, sf)
    keys = clean.filter(F.col("author").isNotNull()).select("author", "group_name").distinct()
    return A.was_forwarded(keys, clean, ["author", "group_name"])


@register("t12_toxicity_scores", S.rounded(["author", "toxicity"], {"toxicity"},
                                           S.with_ctes(*S.BASE, S.TOXICITY) + "SELECT author, tox AS toxicity FROM tox"))
def q_t12s(spark, sf):
    return round_doubles(toxicity_scores(spark, sf, clean_messages(spark, sf)))
