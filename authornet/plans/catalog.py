"""Registered queries: one per inventory row, each a Spark plan over the
driver tables plus (where SQL can say it) an independent DuckDB twin.

Every double column is rounded to 6 places on both sides; counts are
BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sqltwin as S
from .authors import author_group_table, round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _cols(df_cols: str) -> list[str]:
    return [c.strip() for c in df_cols.split(",") if c.strip()]


# ---------------------------------------------------------------------------
# Flagship: cleaned messages -> count features -> per (author, group) table
# ---------------------------------------------------------------------------
FLAGSHIP_MEANS = ["sent_count", "word_count", "avg_sent_length", "avg_word_length",
                  "exclamation_count", "question_count", "emoji_count", "flesch_reading_ease"]
FLAGSHIP_COLS = (["author", "group_name", "channel_messages", "group_messages"] + FLAGSHIP_MEANS +
                 ["own_message", "forwarded_message", "total_message_count", "was_forwarded",
                  "own_message_count", "forwarded_message_count", "avg_flesch_reading_ease_class"])
FLAGSHIP_DOUBLES = set(FLAGSHIP_MEANS) | {"channel_messages", "group_messages", "own_message", "forwarded_message"}


def _flagship_sql() -> str:
    means = ",\n    ".join(f"avg({c}) AS {c}" for c in FLAGSHIP_MEANS)
    inner = S.with_ctes(*S.BASE, S.COUNTS) + f""",
ling AS (
  SELECT author, group_name,
    CAST(sum(CASE WHEN group_or_channel = 'channel' THEN 1 ELSE 0 END) AS BIGINT) AS channel_n,
    CAST(sum(CASE WHEN group_or_channel = 'group' THEN 1 ELSE 0 END) AS BIGINT) AS group_n,
    {means}
  FROM feat1 WHERE own_message = 1 AND author IS NOT NULL AND group_name IS NOT NULL
  GROUP BY author, group_name),
cnt AS (
  SELECT author, group_name, CAST(sum(own_message) AS BIGINT) AS own_n,
    CAST(sum(forwarded_message) AS BIGINT) AS fwd_n, CAST(count(UID_key) AS BIGINT) AS total_message_count
  FROM clean WHERE author IS NOT NULL AND group_name IS NOT NULL GROUP BY author, group_name),
fw AS (
  SELECT fwd_author, group_name, CAST(count(*) AS BIGINT) AS n FROM clean
  WHERE fwd_author IS NOT NULL GROUP BY fwd_author, group_name),
j AS (
  SELECT coalesce(l.author, c.author) AS author, coalesce(l.group_name, c.group_name) AS group_name,
    l.* EXCLUDE (author, group_name), c.* EXCLUDE (author, group_name)
  FROM ling l FULL OUTER JOIN cnt c ON l.author = c.author AND l.group_name = c.group_name)
SELECT j.author, j.group_name,
  CASE WHEN own_n <> 0 THEN channel_n / own_n END AS channel_messages,
  CASE WHEN own_n <> 0 THEN group_n / own_n END AS group_messages,
  {", ".join(FLAGSHIP_MEANS[:-1])},
  CASE WHEN flesch_reading_ease >= 0 AND flesch_reading_ease <= 100 THEN flesch_reading_ease END AS flesch_reading_ease,
  own_n / total_message_count AS own_message, fwd_n / total_message_count AS forwarded_message,
  total_message_count, coalesce(fw.n, 0) AS was_forwarded,
  own_n AS own_message_count, fwd_n AS forwarded_message_count,
  {S.flesch_class("CASE WHEN flesch_reading_ease >= 0 AND flesch_reading_ease <= 100 THEN flesch_reading_ease END")} AS avg_flesch_reading_ease_class
FROM j LEFT JOIN fw ON fw.fwd_author = j.author AND fw.group_name = j.group_name"""
    return S.rounded(FLAGSHIP_COLS, FLAGSHIP_DOUBLES, inner)


@register("a1_author_group_features", _flagship_sql())
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(author_group_table(spark, sf_dir).select(*FLAGSHIP_COLS))


# stage modules register themselves on import
from . import q_clean  # noqa: E402,F401
from . import q_authors  # noqa: E402,F401
from . import q_lexicon  # noqa: E402,F401
from . import q_graph  # noqa: E402,F401
from . import q_stats  # noqa: E402,F401
from . import q_io  # noqa: E402,F401
from . import q_analysis  # noqa: E402,F401
from . import q_fit  # noqa: E402,F401
