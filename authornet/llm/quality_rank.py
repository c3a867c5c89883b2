"""Document quality by pairwise ranking (Bradley-Terry).

A document's score is linear in counts of its whole text (shares of signs, capitals, digits,
repeats, sizes).  The weights come from preference pairs: each low-quality training text is
paired with several high-quality ones, and the logistic loss on the difference of their
features is minimised by Newton's method.  Pairs are drawn from a bounded sample of labelled rows
by a fixed rule, never all against all.  The threshold is a score quantile: that of the training
rows at their share of low quality, or, where the caller names a share, that of all documents.
A logistic curve through the threshold turns scores into probabilities.

Edge cases: null and empty texts have features zero and get that score; labels of one class only
give every document that class's share; an empty table gives an empty result; repeated rows
are scored each; texts of any length are counted in linear time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labels import held_out, training_rows

PARTNERS = 16
RIDGE = 1e-3
PREDICT_FROM = 0.7
QUANTILE_ACCURACY = 10_000
SIGNS = b"#*$%&|<>!?.,;:\"()-="
DIGITS, CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# shares are also given squashed, x / (x + c), so that a little of a sign can weigh as much as a lot
SQUASH = (0.01, 0.1)
SHARES = ("symbols", "shouts", "pipes", "stops", "commas", "other_signs", "capitals", "digits", "not_ascii", "repeated",
          "neighbours", "dup_lines", "unstopped")
FEATURES = ("log_words", "few_words", "very_few_words", "word_size", "short_words", "long_words", "words_a_line",
            *SHARES, *(f"{s}_{c}" for s in SHARES for c in SQUASH))


def features(text: str) -> list[float]:
    """FEATURES of a whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    joined = b"".join(words)
    chars = len(joined)
    count = {c: joined.count(c) for c in SIGNS}
    of = lambda s: sum(count[c] for c in s)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = chars / n
    neighbours = sum(map(bytes.__eq__, words[1:], words[:-1]))
    shares = [of(b"#*$%&<>") / n, count[33] / n, count[124] / n, of(b".?") / n, count[44] / n, of(b";:\"()-=") / n,
              (chars - len(joined.translate(None, CAPITALS))) / chars, (chars - len(joined.translate(None, DIGITS))) / chars,
              1 - len(text) / len(raw), 1 - len(set(words)) / n, neighbours / n, 1 - len(set(lines)) / len(lines),
              1.0 if n >= 40 and not of(b".?!") else 0.0]
    return [float(np.log1p(n)), float(n < 20), float(n < 8), size, max(0.0, 3.5 - size), max(0.0, size - 8),
            float(np.log1p(n / len(lines))), *shares, *(s / (s + c) for s in shares for c in SQUASH)]


def featurize(df: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, y (null outside the training rows) and features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "features"])

    labelled = common.texts(df).join(F.broadcast(rows), "doc_id", "left").select("doc_id", "text", "y")
    return labelled.mapInArrow(run, "doc_id bigint, y int, features array<double>")


def preference_pairs(y: np.ndarray, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse) row numbers: each row of the smaller class meets ``partners``
    rows of the other, dealt in turn, so every row of that class is met about as often."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    k = min(partners, len(many))
    met = many[np.arange(len(few) * k) % len(many)]
    meets = np.repeat(few, k)
    return (met, meets) if few is bad else (meets, met)


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 100) -> np.ndarray:
    """Weights w that minimise the logistic loss of w . (x[better] - x[worse])."""
    diff = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + ridge / 2 * w @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # probability of the wrong order
        grad = -diff.T @ p / len(diff) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step, rate = np.linalg.solve(hess, grad), 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w


class Ranker:
    """Standardised features, weights, and the slope that turns distance from the
    threshold into a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.centre) / self.scale
        self.w = bradley_terry(z, *preference_pairs(y))
        s = z @ self.w
        self.low_share = float((y == 0).mean())
        self.cut = cut = float(np.quantile(s, self.low_share))
        # slope by Newton's method on the labels, the curve held at the threshold
        anchor, slope = np.log(PREDICT_FROM / (1 - PREDICT_FROM)), 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * (s - cut) + anchor, -30, 30)))
            grad, curve = ((p - y) * (s - cut)).mean() + 1e-3 * slope, (p * (1 - p) * (s - cut) ** 2).mean() + 1e-3
            slope = max(1e-3, slope - grad / curve)
        self.slope, self.anchor = float(slope), float(anchor)

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.w


def rank(df: DataFrame, rows: DataFrame, reject_share: float | None = None) -> DataFrame:
    """doc_id, rank_score (Bradley-Terry) and score (probability) of every row.
    The threshold lies at the quantile ``reject_share`` of all documents' scores; None: the share of
    low quality in the training rows."""
    table = common.write_shared(featurize(df, rows), "features")
    # bounded: the training rows; sorted, so that the pairs are the same at any partitioning
    train = sorted((r["doc_id"], r["y"], r["features"]) for r in table.filter("y is not null").collect())
    y = np.array([t[1] for t in train], dtype=float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return table.select("doc_id", F.lit(0.0).alias("rank_score"), F.lit(share).alias("score"))
    ranker = Ranker(np.array([t[2] for t in train]), y)
    w = (ranker.w / ranker.scale).tolist()
    shift = float(ranker.centre / ranker.scale @ ranker.w)
    terms = F.zip_with("features", F.array(*map(F.lit, w)), lambda x, c: x * c)
    scored = table.select("doc_id", (F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) - shift).alias("rank_score"))
    share = ranker.low_share if reject_share is None else reject_share
    cut = scored.agg(F.percentile_approx("rank_score", share, QUANTILE_ACCURACY).alias("q")).first()["q"] or 0.0
    rise = ranker.slope * (F.col("rank_score") - F.lit(float(cut))) + ranker.anchor
    return scored.withColumn("score", 1 / (1 + F.exp(-rise)))


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    out = rank(common.documents(spark, sf_dir), training_rows(spark, sf_dir, "quality"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
