"""Author-level aggregation (A1-A10) and the merges around it.

The reference groups twice (linguistic features of own messages; message
counts of all messages), outer-merges the two, and then scans every message
once per output row to count how often the author was forwarded.  Here the
whole author table is **one** hash aggregation: forwarded-by events are
unioned in as extra narrow rows and counted in the same pass, so the plan
has a single exchange on the grouping keys, with partial aggregation before
it.  The stand-alone operators (``merge_counts``, ``was_forwarded``) are
kept for callers that hold the pieces separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Output columns that must equal the reference's, in its order.
SUM_FEATURES = ["noun_count", "verb_count", "adj_count",
                "positive_sentiment", "negative_sentiment", "neutral_sentiment"]
MEAN_FEATURES = ["sent_count", "word_count", "avg_sent_length", "avg_word_length",
                 "exclamation_count", "question_count", "emoji_count", "flesch_reading_ease",
                 "liwc_I", "liwc_We", "liwc_You", "liwc_Other", "liwc_Affect"]
COUNT_OUT = ["own_message", "forwarded_message", "total_message_count"]

FEATURES_30 = (SUM_FEATURES + ["channel_messages", "group_messages"] + MEAN_FEATURES +
               ["own_message", "forwarded_message", "total_message_count", "was_forwarded",
                "own_message_count", "forwarded_message_count", "action_quotient",
                "sentiment_quotient", "toxicity"])


def keys_present(keys) -> Column:
    """pandas ``groupby`` drops rows with a missing key; Spark keeps them."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _present(df: DataFrame, cols):
    return [c for c in cols if c in df.columns]


def aggregate_features(df: DataFrame, keys=("author", "group_name"), with_forwarded: bool = True,
                       extra_means=()) -> DataFrame:
    """A1-A4 + J2-J5 fused: per key, sums and means of own-message features,
    message counts of all messages, and ``was_forwarded``.

    Semantics kept from the reference: rows with a null key are dropped;
    sums are 0 when the key has own messages whose values are all missing
    but null when the key has no own message at all; means skip missing."""
    keys = list(keys)
    sums = _present(df, SUM_FEATURES)
    means = _present(df, MEAN_FEATURES) + [c for c in extra_means if c in df.columns]
    own = (F.col("own_message") == 1)
    carried = [*sums, *means, "group_or_channel", "own_message", "forwarded_message", "UID_key"]
    base = F.struct(*[F.col(k).alias(k) for k in keys], F.lit(1).alias("_msg"), F.lit(0).alias("_fwd"))
    if with_forwarded:
        # the forwarded-by event of the same message, as a second row
        # produced in the same pass (no second scan of the source)
        fwd_keys = [(F.col("fwd_author") if k == "author" else F.col(k)).alias(k) for k in keys]
        both = F.array(base, F.struct(*fwd_keys, F.lit(0).alias("_msg"), F.lit(1).alias("_fwd")))
    else:
        both = F.array(base)
    keep = lambda r: F.lit(True) if not keys else _all([r[k].isNotNull() for k in keys])
    # the features stay outside the exploded rows, so one that the caller does not read is not computed;
    # below they count only where _msg is 1
    rows = df.select(*[c for c in dict.fromkeys(carried) if c not in keys], F.explode(F.filter(both, keep)).alias("_r")).select(
        *[c for c in dict.fromkeys(carried) if c not in keys], "_r.*")
    own_row = (F.col("_msg") == 1) & own
    n_own = F.sum(F.when(own_row, 1).otherwise(0))

    def own_sum(x: Column) -> Column:
        return F.when(n_own > 0, F.coalesce(F.sum(F.when(own_row, x)), F.lit(0)))

    aggs = [own_sum(F.col(c)).alias(c) for c in sums]
    aggs += [own_sum((F.col("group_or_channel") == "channel").cast("int")).cast("bigint").alias("channel_messages"),
             own_sum((F.col("group_or_channel") == "group").cast("int")).cast("bigint").alias("group_messages")]
    aggs += [F.avg(F.when(own_row, F.col(c))).alias(c) for c in means]
    aggs += [F.sum(F.when(F.col("_msg") == 1, F.col("own_message"))).cast("bigint").alias("own_message"),
             F.sum(F.when(F.col("_msg") == 1, F.col("forwarded_message"))).cast("bigint").alias("forwarded_message"),
             F.count(F.when(F.col("_msg") == 1, F.col("UID_key"))).cast("bigint").alias("total_message_count"),
             F.sum("_fwd").cast("bigint").alias("was_forwarded"),
             F.sum("_msg").alias("_n")]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.filter(F.col("_n") > 0).drop("_n")


def message_counts(df: DataFrame, keys=("author", "group_name")) -> DataFrame:
    """A4 alone: counts over all messages."""
    keys = list(keys)
    return (df.filter(keys_present(keys))
            .groupBy(*keys).agg(F.sum("own_message").cast("bigint").alias("own_message"),
                                F.sum("forwarded_message").cast("bigint").alias("forwarded_message"),
                                F.count("UID_key").cast("bigint").alias("total_message_count")))


def linguistic(df: DataFrame, keys=("author", "group_name")) -> DataFrame:
    """A1-A3 alone: sums and means over own messages."""
    keys = list(keys)
    own = df.filter((F.col("own_message") == 1) & keys_present(keys))
    sums = _present(df, SUM_FEATURES)
    means = _present(df, MEAN_FEATURES)
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    aggs += [F.sum((F.col("group_or_channel") == "channel").cast("int")).cast("bigint").alias("channel_messages"),
             F.sum((F.col("group_or_channel") == "group").cast("int")).cast("bigint").alias("group_messages")]
    aggs += [F.avg(c).alias(c) for c in means]
    return own.groupBy(*keys).agg(*aggs)


def merge_counts(ling: DataFrame, counts: DataFrame, keys=("author", "group_name")) -> DataFrame:
    """Full outer merge on the keys."""
    return ling.join(counts, list(keys), "full")


def merge_features(a: DataFrame, b: DataFrame, on: str = "UID_key") -> DataFrame:
    """Full outer merge of two per-message tables."""
    return a.join(b, on, "full")


def was_forwarded(agg: DataFrame, messages: DataFrame, keys=("author", "group_name")) -> DataFrame:
    """How many messages name the key's author as (raw) ``fwd_author``
    [within the same other keys]: a group-by on the forward side and a left
    join, instead of one scan per output row."""
    keys = list(keys)
    other = [k for k in keys if k != "author"]
    fw = (messages.filter(F.col("fwd_author").isNotNull())
          .groupBy(F.col("fwd_author").alias("author"), *other)
          .agg(F.count(F.lit(1)).cast("bigint").alias("was_forwarded")))
    return (agg.join(fw, keys, "left")
            .withColumn("was_forwarded", F.coalesce("was_forwarded", F.lit(0).cast("bigint"))))


def join_texts(df: DataFrame, keys=("author",), cols=("final_message_string",), order: str = "UID_key",
               part_rows: int = 4096) -> DataFrame:
    """A5: ' '-joined texts (nulls and '' skipped) in ``order``, unique within a key and
    of any orderable type.  A key's messages are numbered in that order and cut into parts
    of ``part_rows`` (part 0, 1, ... within each key), so no collected value holds
    more than that many messages; concatenating the parts in order gives the whole.
    Numbers come from global positions of (keys, order) alone, minus the key's first."""
    from .clean import row_positions
    keys, cols = list(keys), list(cols)
    some = F.lit(False)
    for c in cols:
        some = some | X.has_text(c)
    src = df.filter(some & keys_present(keys))
    pos = row_positions(src.select(F.struct(*keys, order).alias("_o")), "_o")
    first = pos.groupBy(*[F.col(f"_o.{k}").alias(k) for k in keys]).agg(F.min("_pos").alias("_first"))
    part = pos.select(F.col(f"_o.{order}").alias(order), *[F.col(f"_o.{k}").alias(k) for k in keys], "_pos").join(first, keys).select(
        *keys, order, F.floor((F.col("_pos") - F.col("_first")) / F.lit(part_rows)).cast("bigint").alias("part"))
    rows = src.select(*keys, order, *cols).join(part, [*keys, order])

    def whole(c: str) -> Column:
        texts = F.array_sort(F.collect_list(F.when(X.has_text(c), F.struct(F.col(order), F.col(c).alias("text")))))
        return F.array_join(F.transform(texts, lambda r: r["text"]), " ").alias(c)

    joined = [whole(c) for c in cols]
    return rows.groupBy(*keys, "part").agg(*joined)


def attach_texts(agg: DataFrame, texts: DataFrame, keys=("author",), cols=("final_message", "final_message_string")) -> DataFrame:
    """The table of :func:`join_texts` on the aggregated table: one row per key and
    part, so a hot key's text is never one value (a key without text keeps one row)."""
    return agg.join(texts.select(*keys, "part", *cols), list(keys), "left")


def message_ratios(df: DataFrame) -> DataFrame:
    """Keep counts as ``*_count``, turn counts into shares of all messages."""
    return (df.withColumn("own_message_count", F.col("own_message"))
            .withColumn("forwarded_message_count", F.col("forwarded_message"))
            .withColumn("own_message", F.col("own_message_count") / F.col("total_message_count"))
            .withColumn("forwarded_message", F.col("forwarded_message_count") / F.col("total_message_count")))


# The counts that become shares of own messages.
SHARE_COLUMNS = ["positive_sentiment", "negative_sentiment", "neutral_sentiment",
                 "channel_messages", "group_messages"]


def share_of_own(df: DataFrame, cols=SHARE_COLUMNS) -> DataFrame:
    """Counts -> share of own messages; null with no own message."""
    n = F.col("own_message_count")
    return df.withColumns({c: F.when(n != 0, F.col(c) / n).cast("double") for c in _present(df, cols)})


def action_quotient(df: DataFrame) -> DataFrame:
    """Verbs / adjectives, null if no adjective."""
    return df.withColumn("action_quotient", F.col("verb_count") / F.nullif(F.col("adj_count"), F.lit(0)))


def sentiment_quotient(df: DataFrame, pos: str = "positive_sentiment", neg: str = "negative_sentiment") -> DataFrame:
    """Positive / negative message counts, null if none negative.
    Apply before ``share_of_own`` (it reads raw counts)."""
    return df.withColumn("sentiment_quotient", F.col(pos) / F.nullif(F.col(neg), F.lit(0)))


def author_flesch(df: DataFrame) -> DataFrame:
    """A10: mean score outside [0, 100] becomes null, then the class."""
    s = F.col("flesch_reading_ease")
    return (df.withColumn("flesch_reading_ease", F.when((s >= 0) & (s <= 100), s))
            .withColumn("avg_flesch_reading_ease_class", X.flesch_class("flesch_reading_ease")))


def post_features(agg: DataFrame) -> DataFrame:
    """A6-A10 in the reference's order (quotients read raw counts)."""
    df = message_ratios(agg)
    if "adj_count" in df.columns:
        df = action_quotient(df)
    if "negative_sentiment" in df.columns:
        df = sentiment_quotient(df)
    df = share_of_own(df)
    if "flesch_reading_ease" in df.columns:
        df = author_flesch(df)
    return df
