"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes for (1) or against (-1) a document, or abstains (0).  Documents are grouped by their
votes; that table has at most 3 ** len(RULES) rows whatever the corpus, and expectation-maximisation
on it estimates how often each rule votes which way for good and for bad documents.  The posterior
probability of being good is then a sum of one learned weight per vote, written as an ordinary column
expression.  The text is read once: counts and votes go to a written table first.

Edge cases: null and empty texts have no word and fail; an empty table gives an empty result; repeated
rows get the same verdict each; texts of any length are one row's arrays; extra columns are
ignored (or kept, by ``keep_good``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 500
SMOOTHING = 1.0
# Weight of the prior on the rules' votes, as a share of the corpus, and the accuracy of a vote against that it assumes.
PRIOR, ACCURACY = 0.05, 0.7
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout", "n_stops",
            "n_digits")


def counts(texts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts FEATURES of column ``text``."""
    # one projection per step: what is used twice is computed once
    step = texts.select(*keep, "text", F.array_remove(F.split("text", SPACE), "").alias("_w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    n = F.size("_w")
    windows = F.when(n >= REPEAT_WINDOW, F.transform(
        F.sequence(F.lit(1), n - (REPEAT_WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, REPEAT_WINDOW))))
    step = step.select(*keep, n.cast("long").alias("n_words"), F.array_join("_w", "").alias("_j"), lines.alias("_l"),
                       windows.alias("_h"))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.select(
        *keep, "n_words", F.length("_j").cast("long").alias("word_chars"),
        F.regexp_count("_j", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"), F.regexp_count("_j", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_j", F.lit("!")).cast("long").alias("n_shout"),
        F.regexp_count("_j", F.lit("[.?]")).cast("long").alias("n_stops"),
        F.regexp_count("_j", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.when(twice, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("_s"))
    same = lambda e, i: F.get("_s", i)["h"] == e["h"]
    spots = F.transform("_s", lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["p"]))
    kept = [*keep, *(c for c in FEATURES if c != "n_repeat_words")]
    step = step.select(*kept, F.sort_array(F.filter(spots, lambda p: p.isNotNull())).alias("_p"))
    # a window starting at p adds the words up to the next such start, 8 at most
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(REPEAT_WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return step.select(*kept, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """The rules as vote columns over FEATURES."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    size = chars / n
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 60),
        "symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.01),
        "symbol_share": _vote(F.col("n_symbols") / chars > 0.02, F.col("n_symbols") / chars < 0.002),
        "repeats": _vote(per_word("n_repeat_words") > MAX_REPEAT_PERCENT / 100, per_word("n_repeat_words") < 0.05),
        "lines": _vote(F.col("n_dup_lines") * 2 > F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        "word_size": _vote((size < 3) | (size > 10), (size >= 3.5) & (size <= 8)),
        "capitals": _vote(F.col("n_upper") / chars > 0.3, F.col("n_upper") / chars < 0.1),
        "shouting": _vote(per_word("n_shout") > 0.1, per_word("n_shout") < 0.02),
        "stops": _vote((F.col("n_stops") == 0) & (F.col("n_words") >= 80), (per_word("n_stops") > 0.02) & (per_word("n_stops") < 0.4)),
        "digits": _vote(F.col("n_digits") / chars > 0.2, F.col("n_digits") / chars < 0.05),
    }


RULES = ("length", "symbols", "symbol_share", "repeats", "lines", "word_size", "capitals", "shouting", "stops", "digits")


def learn(patterns: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation with rules independent given the class.  ``patterns``:
    (n, rules) votes, ``weights``: documents of each.  Returns the prior log-odds and the
    log-odds of each rule's votes, (rules, 3) for -1, 0, 1.

    Every posterior moves in every round.  What keeps the classes from trading places or drifting to
    whatever splits the corpus best is a prior on each rule's votes, worth ``PRIOR`` of the corpus at any size: the corpus
    shares of its votes, with a vote against ``ACCURACY`` / (1 - ACCURACY) times likelier in bad documents and as much
    rarer in good ones.  The first expectation is the number of votes against."""
    if not len(patterns):
        return 0.0, np.zeros((patterns.shape[1], 3))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    shares = np.einsum("n,nrv->rv", weights, onehot) / weights.sum()

    def tilted(odds: float) -> np.ndarray:
        out = shares * np.array([odds, 1.0, 1.0])
        return PRIOR / 2 * weights.sum() * out / out.sum(axis=1, keepdims=True) + SMOOTHING

    of_good, of_bad = tilted((1 - ACCURACY) / ACCURACY), tilted(ACCURACY / (1 - ACCURACY))
    good = np.array([0.9, 0.5, 0.1])[np.minimum((patterns == -1).sum(axis=1), 2)]
    for _ in range(rounds):
        n_good, n_bad = weights * good, weights * (1 - good)
        p_good, p_bad = (np.einsum("n,nrv->rv", n, onehot) + prior for n, prior in ((n_good, of_good), (n_bad, of_bad)))
        odds = np.log(p_good / p_good.sum(axis=1, keepdims=True)) - np.log(p_bad / p_bad.sum(axis=1, keepdims=True))
        prior = math.log((n_good.sum() + SMOOTHING) / (n_bad.sum() + SMOOTHING))
        new = 1 / (1 + np.exp(-np.clip(prior + np.einsum("nrv,rv->n", onehot, odds), -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return prior, odds


def posterior(prior: float, odds: np.ndarray) -> Column:
    """Probability that a document is good, from its vote columns."""
    total = F.lit(float(prior))
    for rule, (against, abstains, votes) in zip(RULES, odds.tolist()):
        vote = F.col(f"v_{rule}")
        total = total + F.when(vote == -1, against).when(vote == 1, votes).otherwise(abstains)
    return 1 / (1 + F.exp(-total))


def judge(texts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, FEATURES, base_failed, probability and kept of every row."""
    voted = counts(texts, keep).withColumns({f"v_{k}": v for k, v in rules().items()})
    rows = common.write_shared(voted, "votes")
    names = [f"v_{r}" for r in RULES]
    # at most 3 ** len(RULES) rows, whatever the corpus
    table = sorted((tuple(r) for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()))
    votes = np.array([r[:-1] for r in table]).reshape(-1, len(RULES))
    prior, odds = learn(votes, np.array([r[-1] for r in table], dtype=float))
    out = rows.withColumn("probability", posterior(prior, odds)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (all columns) that are kept."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return judge(rows, ("doc",)).filter("kept").select("doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(common.texts(common.documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
