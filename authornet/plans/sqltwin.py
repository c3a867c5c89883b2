"""DuckDB twins of the Spark plans (the correctness oracle).

They are written independently in plain SQL over the driver's views and
share only the fixed values (patterns, fixtures) with the Spark side.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..sources import fixtures as FX


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(P.re2(pattern))}, {q(repl)}, 'g')"


def rx_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(P.re2(pattern))})) AS BIGINT)"


def clean_text(expr: str) -> str:
    return rx_replace(rx_replace(rx_replace(expr, P.A_TAG), P.PLAIN_TAG), P.EMOJI_CLASS + "+")


def has_text(expr: str) -> str:
    return f"({expr} IS NOT NULL AND {expr} <> '')"


RAW = f"raw AS ({FX.MESSAGES_SQL})"

CLEAN = f"""clean0 AS (
  SELECT UID_key,
    lower({rx_replace('author', P.EDGE_WS)}) AS author,
    fwd_message, fwd_author, date, group_or_channel,
    CAST(CASE WHEN coalesce(message, transcribed_message) IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS own_message,
    CAST(CASE WHEN fwd_message IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS forwarded_message,
    group_name,
    {clean_text('fwd_message')} AS fwd_message_string,
    coalesce(message, transcribed_message) AS final_message,
    {rx_replace(f"coalesce({clean_text('message')}, transcribed_message)", P.WS_RUN, ' ')} AS final_message_string
  FROM raw
  WHERE coalesce(message, fwd_message, transcribed_message) IS NOT NULL),
clean AS (
  SELECT * FROM clean0
  WHERE NOT (coalesce(final_message_string = '', false) AND coalesce(fwd_message_string = '', false)))"""


def flesch_class(expr: str) -> str:
    parts = " ".join(f"WHEN {expr} >= {lo} AND {expr} < {hi} THEN {q(label)}" for lo, hi, label in P.FLESCH_BANDS)
    return f"CASE {parts} ELSE {q(P.FLESCH_OTHER)} END"


FMS = "final_message_string"

COUNTS = f"""counts AS (
  SELECT *,
    CASE WHEN {has_text(FMS)} THEN {rx_count(FMS, P.SENT_SEP)} + 1 ELSE CAST(0 AS BIGINT) END AS sent_count,
    CASE WHEN {has_text(FMS)} THEN {rx_count(FMS, P.WORD)} ELSE CAST(0 AS BIGINT) END AS word_count,
    coalesce({rx_count(FMS, P.EXCLAMATION)}, 0) AS exclamation_count,
    coalesce({rx_count(FMS, P.QUESTION)}, 0) AS question_count,
    coalesce({rx_count('final_message', P.EMOJI_CLASS + '+')}, 0) AS emoji_count,
    {rx_count(FMS, P.WORD)} AS _words,
    greatest({rx_count(FMS, P.SENT_SEP)}, 1) AS _sents,
    {rx_count(f'lower({FMS})', P.SYLLABLE)} AS _syl,
    CAST(length(replace({FMS}, ' ', '')) AS BIGINT) AS _chars,
    ({FMS} IS NULL OR {rx_replace(FMS, P.WS_RUN)} = '') AS _blank
  FROM clean),
feat0 AS (
  SELECT * EXCLUDE (_words, _sents, _syl, _chars, _blank),
    CASE WHEN sent_count > 0 THEN word_count / sent_count ELSE 0.0 END AS avg_sent_length,
    CASE WHEN word_count > 0 THEN _chars / word_count ELSE 0.0 END AS avg_word_length,
    CASE WHEN _blank OR _words = 0 THEN NULL
         ELSE 180.0 - _words / _sents - 58.5 * _syl / _words END AS flesch_reading_ease
  FROM counts),
feat1 AS (SELECT *, {flesch_class('flesch_reading_ease')} AS flesch_reading_ease_class FROM feat0)"""

# word tokens for POS / polarity (lower-cased Unicode words), per message
WORDS = f"""words AS (
  SELECT UID_key, unnest(regexp_extract_all(lower({FMS}), {q(P.WORD)})) AS w
  FROM clean WHERE {has_text(FMS)}),
pos_hits AS (
  SELECT w.UID_key,
    CAST(count(*) FILTER (WHERE p.pos = 'NOUN') AS BIGINT) AS noun_count,
    CAST(count(*) FILTER (WHERE p.pos = 'VERB') AS BIGINT) AS verb_count,
    CAST(count(*) FILTER (WHERE p.pos = 'ADJ') AS BIGINT) AS adj_count
  FROM words w JOIN {FX.POS_SQL} p ON w.w = lower(p.word) GROUP BY w.UID_key),
pol AS (
  SELECT w.UID_key, sum(p.score) AS s
  FROM words w JOIN {FX.POLARITY_SQL} p ON w.w = lower(p.word) GROUP BY w.UID_key)"""

# whitespace tokens for the category lexicon
TOKENS = f"""toks AS (
  SELECT UID_key, unnest(string_split_regex(lower({rx_replace(FMS, '^[ \\t\\n]+|[ \\t\\n]+$')}), {q(P.TOKEN_SEP)})) AS tok
  FROM clean WHERE {has_text(FMS)} AND {rx_replace(FMS, '^[ \\t\\n]+|[ \\t\\n]+$')} <> ''),
ntok AS (
  SELECT UID_key, CASE WHEN {has_text(FMS)} AND {rx_replace(FMS, '^[ \\t\\n]+|[ \\t\\n]+$')} <> ''
       THEN CAST(len(string_split_regex(lower({rx_replace(FMS, '^[ \\t\\n]+|[ \\t\\n]+$')}), {q(P.TOKEN_SEP)})) AS BIGINT)
       ELSE 0 END AS n FROM clean),
lex AS (SELECT DISTINCT lower(word) AS word, cat_name FROM {FX.LEXICON_SQL}),
lex_exact AS (SELECT * FROM lex WHERE NOT suffix(word, '*')),
lex_stem AS (SELECT substring(word, 1, length(word) - 1) AS stem, cat_name FROM lex WHERE suffix(word, '*')),
vocab AS (SELECT DISTINCT tok FROM toks),
vocab_exact AS (SELECT v.tok, e.cat_name FROM vocab v JOIN lex_exact e ON v.tok = e.word),
vocab_rest AS (SELECT tok FROM vocab WHERE tok NOT IN (SELECT word FROM lex_exact)),
vocab_best AS (
  SELECT v.tok, max(length(s.stem)) AS n
  FROM vocab_rest v JOIN (SELECT DISTINCT stem FROM lex_stem) s ON starts_with(v.tok, s.stem)
  GROUP BY v.tok),
vocab_prefix AS (
  SELECT b.tok, s.cat_name FROM vocab_best b JOIN lex_stem s ON substring(b.tok, 1, b.n) = s.stem),
vocab_hits AS (SELECT * FROM vocab_exact UNION ALL SELECT * FROM vocab_prefix),
cat_hits AS (
  SELECT t.UID_key, h.cat_name, count(*) AS hits FROM toks t JOIN vocab_hits h ON t.tok = h.tok
  GROUP BY t.UID_key, h.cat_name),
liwc AS (
  SELECT n.UID_key, n.n,
    {", ".join(f"CASE WHEN n.n > 0 THEN coalesce(sum(c.hits) FILTER (WHERE c.cat_name = {q(cat)}), 0) / n.n ELSE 0.0 END AS liwc_{cat}" for cat in P.LEXICON_TARGETS)}
  FROM ntok n LEFT JOIN cat_hits c ON n.UID_key = c.UID_key GROUP BY n.UID_key, n.n)"""

FEATURES = f"""feat AS (
  SELECT f.*,
    CASE WHEN {has_text('f.' + FMS)} THEN coalesce(ph.noun_count, 0) ELSE 0 END AS noun_count,
    CASE WHEN {has_text('f.' + FMS)} THEN coalesce(ph.verb_count, 0) ELSE 0 END AS verb_count,
    CASE WHEN {has_text('f.' + FMS)} THEN coalesce(ph.adj_count, 0) ELSE 0 END AS adj_count,
    CASE WHEN {has_text('f.' + FMS)} THEN CAST(coalesce(pl.s, 0) > 0 AS INTEGER) END AS positive_sentiment,
    CASE WHEN {has_text('f.' + FMS)} THEN CAST(coalesce(pl.s, 0) < 0 AS INTEGER) END AS negative_sentiment,
    CASE WHEN {has_text('f.' + FMS)} THEN CAST(coalesce(pl.s, 0) = 0 AS INTEGER) END AS neutral_sentiment,
    {", ".join(f"lw.liwc_{cat}" for cat in P.LEXICON_TARGETS)}
  FROM feat1 f
  LEFT JOIN pos_hits ph ON f.UID_key = ph.UID_key
  LEFT JOIN pol pl ON f.UID_key = pl.UID_key
  LEFT JOIN liwc lw ON f.UID_key = lw.UID_key)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (RAW, CLEAN)
ALL_FEATURES = (RAW, CLEAN, COUNTS, WORDS, TOKENS, FEATURES)


def rounded(select_cols, double_cols, inner: str, digits: int = 6) -> str:
    """Final projection: doubles rounded to ``digits`` places (the Spark
    side applies the same rounding)."""
    cols = [f"round({c}, {digits}) AS {c}" if c in double_cols else c for c in select_cols]
    return f"SELECT {', '.join(cols)} FROM ({inner}) _r"


SUMS = ["noun_count", "verb_count", "adj_count", "positive_sentiment", "negative_sentiment", "neutral_sentiment"]
MEANS = ["sent_count", "word_count", "avg_sent_length", "avg_word_length", "exclamation_count",
         "question_count", "emoji_count", "flesch_reading_ease", "liwc_I", "liwc_We", "liwc_You",
         "liwc_Other", "liwc_Affect"]
SHARES = ["positive_sentiment", "negative_sentiment", "neutral_sentiment", "channel_messages", "group_messages"]


def author_ctes(keys, name: str = "ag") -> str:
    """Independent SQL for the per-key author table: own-message features,
    all-message counts, full outer merge, forwarded-by counts, ratios."""
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    on = " AND ".join(f"l.{c} = c.{c}" for c in keys)
    fw_keys = ", ".join("fwd_author" if c == "author" else c for c in keys)
    fw_on = " AND ".join(f"fw.{'fwd_author' if c == 'author' else c} = j.{c}" for c in keys)
    coal = ", ".join(f"coalesce(l.{c}, c.{c}) AS {c}" for c in keys)
    sums = ",\n    ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in SUMS)
    means = ",\n    ".join(f"avg({c}) AS {c}" for c in MEANS)
    shares = ",\n  ".join(f"CASE WHEN own_n <> 0 THEN {c} / own_n END AS {c}" for c in SHARES)
    fl = "CASE WHEN flesch_reading_ease >= 0 AND flesch_reading_ease <= 100 THEN flesch_reading_ease END"
    return f"""{name}_ling AS (
  SELECT {k}, {sums},
    CAST(sum(CASE WHEN group_or_channel = 'channel' THEN 1 ELSE 0 END) AS BIGINT) AS channel_messages,
    CAST(sum(CASE WHEN group_or_channel = 'group' THEN 1 ELSE 0 END) AS BIGINT) AS group_messages,
    {means}
  FROM feat WHERE own_message = 1 AND {notnull} GROUP BY {k}),
{name}_cnt AS (
  SELECT {k}, CAST(sum(own_message) AS BIGINT) AS own_n, CAST(sum(forwarded_message) AS BIGINT) AS fwd_n,
    CAST(count(UID_key) AS BIGINT) AS total_message_count
  FROM clean WHERE {notnull} GROUP BY {k}),
{name}_fw AS (
  SELECT {fw_keys}, CAST(count(*) AS BIGINT) AS n FROM clean WHERE fwd_author IS NOT NULL GROUP BY {fw_keys}),
{name}_j AS (
  SELECT {coal}, l.* EXCLUDE ({k}), c.* EXCLUDE ({k})
  FROM {name}_ling l FULL OUTER JOIN {name}_cnt c ON {on}),
{name} AS (
  SELECT {", ".join("j." + c for c in keys)},
  noun_count, verb_count, adj_count,
  {shares},
  {", ".join(c for c in MEANS if c != "flesch_reading_ease")},
  {fl} AS flesch_reading_ease,
  own_n / total_message_count AS own_message, fwd_n / total_message_count AS forwarded_message,
  total_message_count, coalesce(fw.n, 0) AS was_forwarded,
  own_n AS own_message_count, fwd_n AS forwarded_message_count,
  CASE WHEN adj_count <> 0 THEN verb_count / adj_count END AS action_quotient,
  CASE WHEN negative_sentiment <> 0 THEN positive_sentiment / negative_sentiment END AS sentiment_quotient,
  {flesch_class(fl)} AS avg_flesch_reading_ease_class
  FROM {name}_j j LEFT JOIN {name}_fw fw ON {fw_on})"""


TOXICITY = """tox AS (
  SELECT c.author, avg(l.toxic) AS tox FROM clean c JOIN labels l ON l.doc_id = c.UID_key
  WHERE c.own_message = 1 AND c.author IS NOT NULL GROUP BY c.author)"""
