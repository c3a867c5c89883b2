"""Inputs derived from the driver tables.

``messages`` turns ``documents`` into the raw chat-message shape (author,
own / forwarded / transcribed text, group, date).  Every document becomes
one message that holds its whole text; emoji-only, emptied and text-less messages
are extra rows beside them.  The same recipe is written once
as a DataFrame plan and once as SQL (the DuckDB oracle twin).

The small vocabularies (category lexicon, part-of-speech, polarity,
stop-words, lemmas) are fixed test inputs, written inline so that both
engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# ---------------------------------------------------------------------------
# Suffixes attached to some messages (tags, links, emoji, runs)
# ---------------------------------------------------------------------------
SUFFIX_0 = " Wirklich?? \U0001F600\U0001F389 ja \U0001F389"
SUFFIX_1 = ' <b>Nein</b>!!! <a href="http://x.example/1">link</a> ich wir'
EMOJI_ONLY = "\U0001F600\U0001F600"


# Extra messages: keys of their own, from some of the documents.
EMOJI_KEY, EMPTIED_KEY, BLANK_KEY = 1_000_000_000, 2_000_000_000, 3_000_000_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    k = F.col("doc_id")
    text = F.col("text")
    none = F.lit(None).cast("string")
    suffix = F.when(k % 5 == 0, F.lit(SUFFIX_0)).when(k % 5 == 1, F.lit(SUFFIX_1)).otherwise(F.lit(""))
    own = F.when((k % 10 != 7) & (k % 10 != 9), F.concat(text, suffix))
    fwd = (k % 10 == 7) | (k % 10 == 8)

    def row(key, message, fwd_message, transcribed):
        return F.struct(key.alias("UID_key"), message.alias("message"), fwd_message.alias("fwd_message"),
                        transcribed.alias("transcribed_message"))

    emoji = F.lit(EMOJI_ONLY)
    rows = F.array(row(k, own, F.when(fwd, text), F.when(k % 10 == 9, text)),
                   F.when(k % 29 == 0, row(k + EMOJI_KEY, emoji, none, none)),
                   F.when(k % 58 == 0, row(k + EMPTIED_KEY, emoji, emoji, none)),
                   F.when(k % 20 == 19, row(k + BLANK_KEY, none, none, none)))
    aid = F.when(k % 2 == 0, k % 53).otherwise(k % 397).cast("string")
    author = (F.when(k % 41 == 40, none)
              .when(k % 3 == 0, F.concat(F.lit(" Author_"), aid, F.lit(" ")))
              .otherwise(F.concat(F.lit("author_"), aid)))
    src_no = F.substring(F.col("source"), 4, 100).cast("int")
    return d.select("doc_id", "source", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("m")).select(
        "m.UID_key",
        author.alias("author"),
        "m.message",
        "m.fwd_message",
        F.when(F.col("m.fwd_message").isNotNull(), F.concat(F.lit("author_"), (k % 53).cast("string"))).alias("fwd_author"),
        "m.transcribed_message",
        F.concat(F.col("source"), F.lit("_"), (k % 7).cast("string")).alias("group_name"),
        F.when(src_no % 2 == 0, F.lit("group")).otherwise(F.lit("channel")).alias("group_or_channel"),
        F.date_add(F.lit("2021-01-01").cast("date"), (k % 31).cast("int")).alias("date"),
    )


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MESSAGES_SQL = f"""
SELECT UID_key,
  CASE WHEN doc_id % 41 = 40 THEN NULL
       WHEN doc_id % 3 = 0 THEN concat(' Author_', CAST(aid AS VARCHAR), ' ')
       ELSE concat('author_', CAST(aid AS VARCHAR)) END AS author,
  message, fwd_message,
  CASE WHEN fwd_message IS NOT NULL THEN concat('author_', CAST(doc_id % 53 AS VARCHAR)) ELSE NULL END AS fwd_author,
  transcribed_message,
  concat(source, '_', CAST(doc_id % 7 AS VARCHAR)) AS group_name,
  CASE WHEN CAST(substring(source, 4) AS INTEGER) % 2 = 0 THEN 'group' ELSE 'channel' END AS group_or_channel,
  CAST(DATE '2021-01-01' + CAST(doc_id % 31 AS INTEGER) AS DATE) AS date
FROM (
  SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN doc_id % 53 ELSE doc_id % 397 END AS aid, doc_id AS UID_key,
    CASE WHEN doc_id % 10 IN (7, 9) THEN NULL
         ELSE concat(text, CASE WHEN doc_id % 5 = 0 THEN {_sql_str(SUFFIX_0)}
                                WHEN doc_id % 5 = 1 THEN {_sql_str(SUFFIX_1)} ELSE '' END) END AS message,
    CASE WHEN doc_id % 10 IN (7, 8) THEN text ELSE NULL END AS fwd_message,
    CASE WHEN doc_id % 10 = 9 THEN text ELSE NULL END AS transcribed_message
  FROM documents
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN doc_id % 53 ELSE doc_id % 397 END, doc_id + {EMOJI_KEY}, {_sql_str(EMOJI_ONLY)}, NULL, NULL
  FROM documents WHERE doc_id % 29 = 0
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN doc_id % 53 ELSE doc_id % 397 END, doc_id + {EMPTIED_KEY}, {_sql_str(EMOJI_ONLY)}, {_sql_str(EMOJI_ONLY)}, NULL
  FROM documents WHERE doc_id % 58 = 0
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN doc_id % 53 ELSE doc_id % 397 END, doc_id + {BLANK_KEY}, NULL, NULL, NULL
  FROM documents WHERE doc_id % 20 = 19) d
"""

# ---------------------------------------------------------------------------
# Category lexicon (word, category name, category id); a
# trailing '*' marks a prefix stem.
# ---------------------------------------------------------------------------
LEXICON = [
    ("the", "Article", 9), ("that*", "Pronoun", 1), ("i", "I", 2), ("ich", "I", 2),
    ("wir", "We", 3), ("re*", "Affect", 12), ("the*", "Other", 6), ("there*", "Cogmech", 20),
    ("on*", "You", 5), ("one*", "We", 3), ("in", "Preps", 10), ("in", "You", 5),
    ("er*", "Affect", 12), ("ei*", "Affect", 12),
]

# Part-of-speech lexicon (word, tag).
POS_LEXICON = [
    ("tion", "NOUN"), ("orantion", "NOUN"), ("rewh", "NOUN"), ("orre", "NOUN"),
    ("ononst", "NOUN"), ("inoran", "NOUN"), ("hehely", "NOUN"), ("thatin", "NOUN"),
    ("ther", "NOUN"), ("thon", "NOUN"), ("link", "NOUN"),
    ("is", "VERB"), ("was", "VERB"), ("be", "VERB"), ("are", "VERB"), ("ha", "VERB"),
    ("ing", "VERB"), ("ed", "VERB"), ("ist", "VERB"),
    ("ble", "ADJ"), ("ly", "ADJ"), ("nt", "ADJ"), ("st", "ADJ"), ("ea", "ADJ"),
    ("the", "DET"), ("der", "DET"), ("die", "DET"),
]

# Polarity lexicon (word, score).
POLARITY_LEXICON = [
    ("ja", 1), ("wirklich", 1), ("ble", 1), ("ly", 1), ("ing", 1), ("good", 1),
    ("nein", -1), ("tion", -1), ("orre", -1), ("rewh", -1), ("st", -1), ("bad", -1),
]

# Stop-words and lemmas for text preprocessing.
STOPWORDS = ["the", "of", "and", "to", "a", "is", "that", "it", "for", "on",
             "der", "die", "und", "den", "das", "de", "la", "en", "le", "et"]
LEMMAS = [("was", "be"), ("is", "be"), ("are", "be"), ("des", "de"), ("les", "le"),
          ("den", "der"), ("das", "der"), ("une", "un")]


def values_sql(rows, cols) -> str:
    """The same rows as an inline ``VALUES`` relation for SQL twins."""
    def lit(v):
        return _sql_str(v) if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


# SQL text of the small tables; as literal relations their size is known to the optimiser.
LEXICON_SQL = values_sql(LEXICON, ["word", "cat_name", "categories"])
POS_SQL = values_sql(POS_LEXICON, ["word", "pos"])
POLARITY_SQL = values_sql(POLARITY_LEXICON, ["word", "score"])
LEMMA_SQL = values_sql(LEMMAS, ["word", "lemma"])


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {LEXICON_SQL}")


def pos_df(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {POS_SQL}")


def polarity_df(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {POLARITY_SQL}")


def lemma_df(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {LEMMA_SQL}")
