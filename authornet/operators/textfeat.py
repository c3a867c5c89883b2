"""Message-level features (T1-T13) on the cleaned message table.

``message_features`` is one projection: all counts, the reading-ease score
and class, the part-of-speech and polarity lookups and the lexicon rates
are evaluated in the stage that scans the message, so the text is read
once and never shuffled.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from . import lexicon as L

COUNT_FEATURES = ["sent_count", "word_count", "avg_sent_length", "avg_word_length",
                  "exclamation_count", "question_count", "emoji_count"]


def count_features(df: DataFrame, text: str = "final_message_string", raw: str = "final_message",
                   with_flesch: bool = False) -> DataFrame:
    """T1-T7 (and T8/T9 with ``with_flesch``).  The regex scans every
    feature shares (word runs, sentence separators) run once per message
    into helper columns; the features are arithmetic on those."""
    has = X.has_text(text)
    zero = F.lit(0).cast("bigint")
    base = df.withColumns({
        "_ht": has,
        "_w": F.coalesce(F.size("_words").cast("bigint") if "_words" in df.columns else X._count(text, P.WORD), zero),
        "_s": F.coalesce(X._count(text, P.SENT_SEP), zero),
        "_c": F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))),
    })
    wc = F.when(F.col("_ht"), F.col("_w")).otherwise(zero)
    sc = F.when(F.col("_ht"), F.col("_s") + 1).otherwise(zero)
    out = base.withColumns({
        "sent_count": sc,
        "word_count": wc,
        "avg_sent_length": F.when(sc > 0, wc / sc).otherwise(F.lit(0.0)),
        "avg_word_length": F.when(wc > 0, F.col("_c") / wc).otherwise(F.lit(0.0)),
        "exclamation_count": X.exclamation_count(text),
        "question_count": X.question_count(text),
        "emoji_count": X.emoji_count(raw),
    })
    if with_flesch:
        w, s = F.col("_w"), F.greatest(F.col("_s"), F.lit(1).cast("bigint"))
        score = F.lit(180.0) - w / s - F.lit(58.5) * X.syllable_count(text) / w
        out = out.withColumn("flesch_reading_ease", F.when(w > 0, score))
        out = out.withColumn("flesch_reading_ease_class", X.flesch_class("flesch_reading_ease"))
    return out.drop("_ht", "_w", "_s", "_c")


def flesch_features(df: DataFrame, text: str = "final_message_string") -> DataFrame:
    """T8/T9."""
    return (df.withColumn("flesch_reading_ease", X.flesch_de(text))
            .withColumn("flesch_reading_ease_class", X.flesch_class("flesch_reading_ease")))


def message_features(clean: DataFrame, pos_lexicon: DataFrame | None = None,
                     polarity: DataFrame | None = None, lexicon: DataFrame | None = None,
                     lexicon_plan: str = "auto") -> DataFrame:
    """T1-T11 and L5-L10 on the cleaned message table (one narrow stage
    with the inline lexicon plan)."""
    # the words are cut once: their number, the POS tags and the polarity read the same array
    df = count_features(L.with_words(clean) if pos_lexicon is not None or polarity is not None else clean, with_flesch=True)
    if pos_lexicon is not None:
        df = L.pos_counts(df, pos_lexicon)
    if polarity is not None:
        df = L.sentiment_flags(df, polarity)
    df = df.drop("_words")
    if lexicon is not None:
        df = L.lexicon_rates(df, lexicon, plan=lexicon_plan)
    return df


def toxicity(authors: DataFrame, scores: DataFrame, key: str = "author",
             gate: str = "own_message") -> DataFrame:
    """Attach a per-key toxicity score, kept only where the own-message
    ratio is exactly 1 (any forwarded message -> null).  ``scores`` is a
    (key, toxicity) table, e.g. the mean per-message score of an author."""
    s = scores.select(key, F.col("toxicity").cast("double").alias("_tox"))
    out = authors.join(s, key, "left")
    return out.withColumn("toxicity", F.when(F.col(gate) == 1, F.col("_tox"))).drop("_tox")


# Characters of long texts that are cut into pieces at once.
CHARS_AT_ONCE = 1 << 22


def _by_chars(pdf: pd.DataFrame, col: str) -> Iterator[pd.DataFrame]:
    """The rows in order, in frames of about CHARS_AT_ONCE characters (a row is never divided)."""
    part = pdf[col].str.len().fillna(0).cumsum() // CHARS_AT_ONCE if len(pdf) else []
    for _, rows in pdf.groupby(part, sort=False) if len(pdf) else [(0, pdf)]:
        yield rows.copy()


def score_batches(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series], out: str = "score",
                  retries: int = 3, backoff: float = 2.0, max_chars: int | None = None,
                  sleep: Callable[[float], None] = time.sleep, on_failure: str = "mark") -> DataFrame:
    """Score a text column with an external batch scorer inside the
    executors (Arrow batches).  Each batch is retried ``retries`` times with
    exponential back-off; the rows of a batch that still fails score null, and
    ``{out}_error`` says why.  A text that the scorer gives no score (with ``max_chars``:
    any piece of it) is such a failure as well; a null text without a score is none.
    ``on_failure='raise'`` ends the job with the error instead.  With ``max_chars``
    the scorer sees pieces of at most that many characters, all of them, and a
    text's score is the mean of its pieces' weighted by their length."""
    if on_failure not in ("mark", "raise"):
        raise ValueError(f"on_failure is 'mark' or 'raise', not {on_failure!r}")
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in (_by_chars(whole, col) if max_chars else [whole])):
            texts, row = pdf[col].astype(object), None
            given = texts.notna()
            if max_chars:
                pieces = [(i, s[k:k + max_chars] if isinstance(s, str) else s) for i, s in enumerate(texts)
                          for k in range(0, max(len(s), 1) if isinstance(s, str) else 1, max_chars)]
                row = pd.Series([i for i, _ in pieces], dtype="int64")
                texts = pd.Series([s for _, s in pieces], dtype=object)
            result, failure = None, None
            for attempt in range(retries):
                try:
                    result = pd.Series(fn(texts).to_numpy(dtype="float64", na_value=float("nan")), index=texts.index)
                    break
                except Exception as error:  # scorer failure: back off and retry
                    failure = error
                    if attempt < retries - 1:
                        sleep(backoff ** attempt)
            if result is not None and row is not None:
                size = texts.str.len().fillna(1).clip(lower=1).astype("float64")
                mean = (result * size).groupby(row).sum(min_count=1) / size.groupby(row).sum()
                result = mean.mask(result.isna().groupby(row).any()).set_axis(pdf.index)
            pdf[out] = result if result is not None else float("nan")
            pdf[out] = pdf[out].astype("float64").where(pdf[out].notna(), None)
            why = "the scorer gave no score" if result is not None else f"{retries} attempts failed: {failure!r}"
            missed = given & pdf[out].isna() if result is not None else pd.Series(True, index=pdf.index)
            if on_failure == "raise" and missed.any():
                raise RuntimeError(f"{int(missed.sum())} of {len(pdf)} texts without a score: {why}") from failure
            pdf[f"{out}_error"] = pd.Series(None, index=pdf.index, dtype=object).mask(missed, why)
            yield pdf
    return df.mapInPandas(run, schema)
