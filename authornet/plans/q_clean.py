"""Registered queries for scans, cleaning, sampling and per-message text
features (S1, P1-P23, T1-T13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import clean as C
from ..operators import lexicon as L
from ..operators import textfeat as TF
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import sinks
from ..sources.tables import read_messages, table
from . import sqltwin as S
from .authors import clean_messages, message_features, raw_messages, round_doubles
from .catalog import register

BASE = S.with_ctes(*S.BASE)
FEAT = S.with_ctes(*S.BASE, S.COUNTS)
FULL = S.with_ctes(*S.ALL_FEATURES)
RAW_COLS = "UID_key, author, message, fwd_message, fwd_author, date, transcribed_message, group_name, group_or_channel"
CLEAN_COLS = ", ".join(C.CLEAN_COLUMNS)


# --- S1 / S3: CSV round trip -------------------------------------------------
@register("s1_read_messages", S.with_ctes(S.RAW) + f"SELECT {RAW_COLS} FROM raw")
def q_s1(spark, sf):
    """Write the raw messages as gzip CSV with a leading index column (the
    reference's file shape), read them back with ``read_messages``."""
    path = scratch_path(spark, "s1")
    raw = raw_messages(spark, sf)
    sinks.write_table(raw.select(F.lit(0).alias("_c0"), *raw.columns), path, fmt="csv")
    return read_messages(spark, path).select(*[c.strip() for c in RAW_COLS.split(",")])


# --- P1-P11 --------------------------------------------------------------------
@register("p1_normalize_author", S.with_ctes(S.RAW) + f"SELECT UID_key, lower({S.rx_replace('author', P.EDGE_WS)}) AS author FROM raw")
def q_p1(spark, sf):
    return C.normalize_author(raw_messages(spark, sf)).select("UID_key", "author")


@register("p2_to_day", S.with_ctes(S.RAW) + "SELECT UID_key, CAST(CAST(date AS VARCHAR) AS DATE) AS date FROM raw")
def q_p2(spark, sf):
    return C.to_day(raw_messages(spark, sf).withColumn("date", F.col("date").cast("string"))).select("UID_key", "date")


@register("p3_flag_own", S.with_ctes(S.RAW) + "SELECT UID_key, CAST(CASE WHEN coalesce(message, transcribed_message) IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS own_message FROM raw")
def q_p3(spark, sf):
    return C.flag_own(raw_messages(spark, sf)).select("UID_key", "own_message")


@register("p4_flag_forwarded", S.with_ctes(S.RAW) + "SELECT UID_key, CAST(CASE WHEN fwd_message IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS forwarded_message FROM raw")
def q_p4(spark, sf):
    return C.flag_forwarded(raw_messages(spark, sf)).select("UID_key", "forwarded_message")


@register("p5_keep_columns", S.with_ctes(S.RAW) + "SELECT UID_key, author, group_name, date FROM raw")
def q_p5(spark, sf):
    return C.keep_columns(raw_messages(spark, sf), ["UID_key", "author", "group_name", "date"])


@register("p6_has_any_text", S.with_ctes(S.RAW) + "SELECT UID_key FROM raw WHERE coalesce(message, fwd_message, transcribed_message) IS NOT NULL")
def q_p6(spark, sf):
    return C.has_any_text(raw_messages(spark, sf)).select("UID_key")


@register("p7_remove_tags", S.with_ctes(S.RAW) + f"SELECT UID_key, {S.rx_replace(S.rx_replace('message', P.A_TAG), P.PLAIN_TAG)} AS message FROM raw")
def q_p7(spark, sf):
    return raw_messages(spark, sf).select("UID_key", X.remove_tags("message").alias("message"))


@register("p8_remove_emojis", S.with_ctes(S.RAW) + f"SELECT UID_key, {S.rx_replace('message', P.EMOJI_CLASS + '+')} AS message FROM raw")
def q_p8(spark, sf):
    return raw_messages(spark, sf).select("UID_key", X.remove_emojis("message").alias("message"))


@register("p9_final_text", BASE + "SELECT UID_key, final_message, final_message_string, fwd_message_string FROM clean0")
def q_p9(spark, sf):
    df = C.final_text(C.has_any_text(raw_messages(spark, sf)))
    return df.select("UID_key", "final_message", "final_message_string", "fwd_message_string")


@register("p10_collapse_ws", S.with_ctes(S.RAW) + f"SELECT UID_key, {S.rx_replace('message', P.WS_RUN, ' ')} AS message FROM raw")
def q_p10(spark, sf):
    return raw_messages(spark, sf).select("UID_key", X.collapse_ws("message").alias("message"))


@register("p11_drop_emptied", BASE + f"SELECT {CLEAN_COLS} FROM clean")
def q_p11(spark, sf):
    return clean_messages(spark, sf)


# --- P12-P14 sampling and union ----------------------------------------------
@register("p12_sample_n", BASE + "SELECT UID_key, author FROM clean ORDER BY md5(concat('42:', CAST(UID_key AS VARCHAR))), UID_key LIMIT 200")
def q_p12(spark, sf):
    return C.sample_n(clean_messages(spark, sf), 200, seed=42).select("UID_key", "author")


@register("p12_sample_clean", S.with_ctes(S.RAW) + """,
pre AS (SELECT * FROM raw WHERE coalesce(message, fwd_message, transcribed_message) IS NOT NULL
        ORDER BY md5(concat('42:', CAST(UID_key AS VARCHAR))), UID_key LIMIT 700),
""" + S.CLEAN.replace("FROM raw", "FROM pre") + """
SELECT UID_key, author, final_message_string FROM clean
ORDER BY md5(concat('42:', CAST(UID_key AS VARCHAR))), UID_key LIMIT 200""")
def q_p12c(spark, sf):
    return C.sample_clean(raw_messages(spark, sf), 200, seed=42).select("UID_key", "author", "final_message_string")


@register("p12_sample_fraction", BASE + "SELECT UID_key FROM clean WHERE CAST(('0x' || substring(md5(concat('7:', CAST(UID_key AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25")
def q_p12f(spark, sf):
    return C.sample_fraction(clean_messages(spark, sf), 0.25, seed=7).select("UID_key")


def _balanced_sql(by: str, n: int) -> str:
    """Water-filling by recursion over the strata from the smallest on."""
    return BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
st AS (SELECT {by} AS g, count(*) AS c FROM clean WHERE {by} IS NOT NULL GROUP BY {by}),
ord AS (SELECT g, c, row_number() OVER (ORDER BY c, CAST(g AS VARCHAR)) AS i, count(*) OVER () AS m FROM st),
fill AS (SELECT i, least({n} // m, c) AS q, {n} - least({n} // m, c) AS rest FROM ord WHERE i = 1
  UNION ALL SELECT o.i, least(f.rest // (o.m - o.i + 1), o.c), f.rest - least(f.rest // (o.m - o.i + 1), o.c)
  FROM fill f JOIN ord o ON o.i = f.i + 1)
SELECT s.UID_key, s.{by} FROM (
  SELECT UID_key, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat('42:', CAST(UID_key AS VARCHAR))), UID_key) AS rn
  FROM clean WHERE {by} IS NOT NULL) s JOIN ord ON ord.g = s.{by} JOIN fill ON fill.i = ord.i WHERE s.rn <= fill.q"""


@register("p13_sample_balanced", _balanced_sql("group_or_channel", 300))
def q_p13(spark, sf):
    """n = 300 over two strata."""
    return C.sample_balanced(clean_messages(spark, sf), 300, "group_or_channel").select("UID_key", "group_or_channel")


@register("p13_sample_balanced_groups", _balanced_sql("group_name", 500))
def q_p13g(spark, sf):
    """n = 500 over all groups: many strata, most smaller than their share."""
    return C.sample_balanced(clean_messages(spark, sf), 500, "group_name").select("UID_key", "group_name")


CONV_AS_MESSAGES = "conv_id * 1000 + turn"


@register("p14_union_tagged", S.with_ctes(S.RAW) + f"""
SELECT UID_key, author, message, 'group' AS group_or_channel FROM raw
UNION ALL
SELECT {CONV_AS_MESSAGES} AS UID_key, role AS author, text AS message, 'channel' AS group_or_channel FROM conversations""")
def q_p14(spark, sf):
    msgs = raw_messages(spark, sf).select("UID_key", "author", "message")
    conv = table(spark, sf, "conversations").select(
        F.expr(CONV_AS_MESSAGES).alias("UID_key"), F.col("role").alias("author"), F.col("text").alias("message"))
    return C.union_tagged({"group": msgs, "channel": conv})


# --- P15-P23 -------------------------------------------------------------------
@register("p15_own_only", BASE + "SELECT UID_key FROM clean WHERE own_message = 1")
def q_p15(spark, sf):
    return C.own_only(clean_messages(spark, sf)).select("UID_key")


@register("p16_one_hot", BASE + """SELECT UID_key,
  CAST(group_or_channel = 'channel' AS INTEGER) AS group_or_channel_channel,
  CAST(group_or_channel = 'group' AS INTEGER) AS group_or_channel_group FROM clean""")
def q_p16(spark, sf):
    df = C.one_hot(clean_messages(spark, sf), "group_or_channel", ["channel", "group"])
    return df.select("UID_key", "group_or_channel_channel", "group_or_channel_group")


@register("p17_rename", BASE + "SELECT UID_key AS total_message_count, group_or_channel AS kind FROM clean")
def q_p17(spark, sf):
    return C.rename(clean_messages(spark, sf).select("UID_key", "group_or_channel"),
                    {"UID_key": "total_message_count", "group_or_channel": "kind"})


# Names of the non-empty clusters.
RECODE = {0: "Cluster 1", 3: "Cluster 2", 4: "Cluster 3", 5: "Cluster 4"}


@register("p18_recode", "SELECT vec_id, CASE label " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in RECODE.items())
          + " END AS cluster FROM embeddings")
def q_p18(spark, sf):
    return C.recode(table(spark, sf, "embeddings").select("vec_id", "label"), "label", RECODE, out="cluster") \
        .select("vec_id", "cluster")


@register("p19_fill_zero", FEAT + "SELECT UID_key, coalesce(round(flesch_reading_ease, 6), 0) AS flesch_reading_ease FROM feat1")
def q_p19(spark, sf):
    df = message_features(spark, sf, full=False).select("UID_key", F.round("flesch_reading_ease", 6).alias("flesch_reading_ease"))
    return C.fill_zero(df, ["flesch_reading_ease"])


@register("p20_assemble", FEAT + """SELECT UID_key, [CAST(sent_count AS DOUBLE), CAST(word_count AS DOUBLE),
  round(avg_word_length, 6), coalesce(round(flesch_reading_ease, 6), 0.0)] AS x FROM feat1""")
def q_p20(spark, sf):
    df = message_features(spark, sf, full=False)
    df = df.withColumn("avg_word_length", F.round("avg_word_length", 6)) \
        .withColumn("flesch_reading_ease", F.round("flesch_reading_ease", 6))
    return C.assemble(df, ["sent_count", "word_count", "avg_word_length", "flesch_reading_ease"], keep=["UID_key"])


@register("p21_chunk_text", BASE + """SELECT UID_key, CAST(part AS INTEGER) AS part, substring(final_message_string, CAST(part * 500 + 1 AS BIGINT), 500) AS text
FROM (SELECT UID_key, final_message_string, unnest(range(CAST(greatest(ceil(length(final_message_string) / 500.0), 1) AS BIGINT))) AS part
      FROM clean WHERE final_message_string IS NOT NULL) t""")
def q_p21(spark, sf):
    """Whole texts in pieces of at most 500 characters (a scorer's limit)."""
    df = clean_messages(spark, sf).filter(F.col("final_message_string").isNotNull())
    return df.select("UID_key", F.posexplode(X.chunk_text("final_message_string", 500)).alias("part", "text"))


@register("p22_batch_ids", BASE + "SELECT UID_key, CAST(floor((row_number() OVER (ORDER BY UID_key) - 1) / 95) AS BIGINT) AS batch_id FROM clean")
def q_p22(spark, sf):
    return C.batch_ids(clean_messages(spark, sf).select("UID_key"), 95)


@register("p23_preprocess_text", BASE + f"""
, w AS (
  SELECT UID_key, unnest(ws) AS tok, generate_subscripts(ws, 1) AS pos FROM (
    SELECT UID_key, regexp_extract_all(lower(final_message_string), {S.q(P.WORD)}) AS ws FROM clean) t),
kept AS (
  SELECT w.UID_key, w.pos, coalesce(l.lemma, w.tok) AS t FROM w LEFT JOIN {FX.LEMMA_SQL} l ON w.tok = l.word
  WHERE w.tok NOT IN ({", ".join(S.q(s) for s in FX.STOPWORDS)}))
SELECT c.UID_key, coalesce(p.txt, '') AS preprocessed FROM clean c
LEFT JOIN (SELECT UID_key, string_agg(t, ' ' ORDER BY pos) AS txt FROM kept GROUP BY UID_key) p ON c.UID_key = p.UID_key""")
def q_p23(spark, sf):
    df = clean_messages(spark, sf).select("UID_key", "final_message_string")
    return C.preprocess_text(df, "final_message_string", FX.STOPWORDS, FX.lemma_df(spark)).select("UID_key", "preprocessed")


# --- T1-T9 -----------------------------------------------------------------------
_T = [("t1_sent_count", "sent_count"), ("t2_word_count", "word_count"), ("t3_avg_sent_length", "avg_sent_length"),
      ("t4_avg_word_length", "avg_word_length"), ("t5_exclamation_count", "exclamation_count"),
      ("t6_question_count", "question_count"), ("t7_emoji_count", "emoji_count"),
      ("t8_flesch_de", "flesch_reading_ease"), ("t9_flesch_class", "flesch_reading_ease_class")]
_DOUBLE_T = {"avg_sent_length", "avg_word_length", "flesch_reading_ease"}


def _t_query(col):
    def fn(spark, sf):
        return round_doubles(message_features(spark, sf, full=False).select("UID_key", col))
    return fn


for _name, _col in _T:
    register(_name, S.rounded(["UID_key", _col], _DOUBLE_T, FEAT + f"SELECT UID_key, {_col} FROM feat1"))(_t_query(_col))


_ALL_T = ["UID_key"] + [c for _, c in _T] + ["noun_count", "verb_count", "adj_count", "positive_sentiment", "negative_sentiment",
                                             "neutral_sentiment"] + [f"liwc_{c}" for c in P.LEXICON_TARGETS]


@register("t_all_features", S.rounded(_ALL_T, _DOUBLE_T | {f"liwc_{c}" for c in P.LEXICON_TARGETS}, FULL + "SELECT * FROM feat"))
def q_tall(spark, sf):
    """Every per-message feature in one narrow stage."""
    return round_doubles(message_features(spark, sf, full=True).select(*_ALL_T))


@register("t10_pos_counts", FULL + "SELECT UID_key, noun_count, verb_count, adj_count FROM feat")
def q_t10(spark, sf):
    return L.pos_counts(clean_messages(spark, sf), FX.pos_df(spark)).select("UID_key", "noun_count", "verb_count", "adj_count")


@register("t10_pos_counts_join", FULL + "SELECT UID_key, noun_count, verb_count, adj_count FROM feat")
def q_t10j(spark, sf):
    """The plan for a lexicon of any size."""
    df = clean_messages(spark, sf).select("UID_key", "final_message_string")
    return L.pos_counts(df, FX.pos_df(spark), plan="join").select("UID_key", "noun_count", "verb_count", "adj_count")


@register("t11_sentiment_flags_join", FULL + "SELECT UID_key, positive_sentiment, negative_sentiment, neutral_sentiment FROM feat")
def q_t11j(spark, sf):
    df = clean_messages(spark, sf).select("UID_key", "final_message_string")
    return L.sentiment_flags(df, FX.polarity_df(spark), plan="join") \
        .select("UID_key", "positive_sentiment", "negative_sentiment", "neutral_sentiment")


@register("t11_sentiment_flags", FULL + "SELECT UID_key, positive_sentiment, negative_sentiment, neutral_sentiment FROM feat")
def q_t11(spark, sf):
    return L.sentiment_flags(clean_messages(spark, sf), FX.polarity_df(spark)) \
        .select("UID_key", "positive_sentiment", "negative_sentiment", "neutral_sentiment")


def _length_scorer(s: pd.Series) -> pd.Series:
    """Deterministic stand-in scorer: characters / 1000."""
    return s.str.len() / 1000.0


@register("t13_score_batches", BASE + """, pieces AS (
  SELECT UID_key, length(final_message_string) AS n, unnest(range(CAST(greatest(ceil(length(final_message_string) / 500.0), 1) AS BIGINT))) AS part
  FROM clean WHERE final_message_string IS NOT NULL),
scored AS (SELECT UID_key, n, least(500, n - 500 * part) AS size FROM pieces)
SELECT c.UID_key, round(s.score, 6) AS score FROM clean c LEFT JOIN (
  SELECT UID_key, CASE WHEN max(n) = 0 THEN 0.0 ELSE sum(size * (size / 1000.0)) / max(n) END AS score FROM scored GROUP BY UID_key) s ON s.UID_key = c.UID_key""")
def q_t13(spark, sf):
    """Every piece of at most 500 characters is scored; a message's score is
    their mean weighted by length."""
    df = clean_messages(spark, sf).select("UID_key", "final_message_string")
    scored = TF.score_batches(df, "final_message_string", _length_scorer, out="score", max_chars=500, on_failure="raise")
    return round_doubles(scored.select("UID_key", "score"))
