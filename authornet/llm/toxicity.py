"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are lower-cased words and the stems (first letters) they begin with.  Every entry that the training texts use often
enough to be estimated is scored: one pass counts the entries of toxic and of clean training texts, a second one their uses in the
whole corpus, which give the Dirichlet prior of both classes.  Log-odds shrink by their own uncertainty, 1 - (2 / z)^2 of them
stays and nothing within two deviations, so no entry is left out by a count of its toxic texts.  A word scores as its longest
entry; a small constant is taken off every word, so that segments end.

The linear-time scan of Ruzzo and Tompa finds all maximal segments of a text.  A segment's score is
calibrated as an extreme value: lambda from the scores' distribution over the whole corpus (less the toxic class's share), K from the
best segments of clean training texts, so log(K n) is taken off for a text of n words.  The best
segment and the sum of the significant ones become a probability by logistic regression.

Edge cases: null and empty texts have no segment and get the score of a text without one; labels
of one class only give every document that class's share; an empty table gives an empty
result; repeated rows are scored each; texts of any length take linear time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontam import NORMAL
from .labels import held_out, training_rows
from .tokens import byte_slices

STEMS = (4, 5, 6, 7)
# Uses in training texts that an entry needs to be estimated (a word with fewer scores as its stem), and the largest
# share of all uses that this may come to: so there are at most MOST_ENTRIES of one length.
MIN_USES, MOST_ENTRIES = 10, 1_000_000
# Deviations within which log-odds are taken for chance.
CHANCE_Z = 2.0
# What every word costs, so that segments of indifferent words lose.
DRIFT = 0.02
# weight of the prior against the training texts' own words
PRIOR_SHARE = 0.02
# a text's uses of one word beyond these tell no more about it (words repeat inside a text); all counts are taken so
USES_PER_TEXT = 4
SIGNIFICANT = 0.0
CACHED_WORDS = 300_000
# words that a task holds before it hands their counts on
HELD_ENTRIES = 400_000
PREDICT_FROM = 0.3


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers of all texts one after the other, their ends per text, the distinct words): lower-cased runs of
    letters, digits and everything beyond ASCII, cut and numbered by Arrow kernels."""
    low = pa.concat_arrays([pc.utf8_lower(texts)])
    _, offsets, data = low.buffers()
    plain = data.to_pybytes().translate(NORMAL) if data is not None else b""
    rows = pc.split_pattern(pa.StringArray.from_buffers(len(low), offsets, pa.py_buffer(plain), offset=low.offset), " ")
    coded = rows.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    ends = rows.offsets.to_numpy()[1:].astype(np.int64) - rows.offsets[0].as_py()
    if "" in words:  # between two separators
        real = codes != words.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return codes, ends, words


def entries(w: str) -> list[str]:
    """The word and its stems (marked by a star), longest first."""
    return [w, *(w[:k] + "*" for k in reversed(STEMS) if len(w) >= k)]


def _labelled(df: DataFrame, rows: DataFrame) -> DataFrame:
    """texts with y (null outside the training rows); the rows are bounded, so they are broadcast."""
    return common.texts(df).join(F.broadcast(rows), "doc_id", "left")


def _count(df: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(entry, toxic, clean, rest) of ``df`` (text, y): uses of each entry (of ``wanted``, where given) and, under "", of all
    words, by the class of the text (rest: not a training text).  Tasks sum theirs before the shuffle."""
    sent = common.send(df.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent()
        words: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            """Uses of the words met so far, by entry."""
            uses = {"": sum(words.values(), np.zeros(3, dtype=np.int64))}
            for w, n in words.items():
                for e in entries(w):
                    if wanted is None or e in wanted:
                        uses[e] = uses[e] + n if e in uses else n
            table = np.array(list(uses.values())).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), *[pa.array(table[:, k]) for k in range(3)]],
                                              names=["entry", "toxic", "clean", "rest"])

        for batch in batches:
            kind = pc.subtract(1, batch.column(1)).fill_null(2).to_numpy().astype(np.int64)
            for at, texts in byte_slices(batch.column(0).cast(pa.string())):
                codes, ends, names = word_codes(texts)
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                met, n = np.unique(doc * len(names) + codes, return_counts=True)
                doc, code = np.divmod(met, max(len(names), 1))
                table = np.bincount(code * 3 + kind[at + doc], np.minimum(n, USES_PER_TEXT), 3 * len(names)).astype(np.int64).reshape(-1, 3)
                for w, n in zip(names, table):
                    if w:
                        words[w] = words[w] + n if w in words else n
                if len(words) > HELD_ENTRIES:
                    yield rows()
                    words = {}
        yield rows()

    counted = df.select("text", "y").mapInArrow(run, "entry string, toxic bigint, clean bigint, rest bigint")
    return counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "rest")])


def count_entries(df: DataFrame, rows: DataFrame) -> dict[str, np.ndarray]:
    """Uses of every entry with enough of them ("" for all words) in toxic training texts, clean training texts and the whole
    corpus.  The entries are chosen on the training rows and counted over every document."""
    mine = common.texts(df).join(F.broadcast(rows), "doc_id")
    trained = common.write_shared(_count(mine, None), "entries")
    total = trained.filter("entry = ''").agg(F.coalesce(F.sum(F.col("toxic") + F.col("clean")), F.lit(0))).first()[0]
    least = max(MIN_USES, total / MOST_ENTRIES)
    # at most total / least words and as many stems of each length
    often = {r["entry"]: (r["toxic"], r["clean"]) for r in trained.filter((F.col("toxic") + F.col("clean") >= least) | (F.col("entry") == "")).collect()}
    every = _count(_labelled(df, rows), frozenset(often)).select("entry", (F.col("toxic") + F.col("clean") + F.col("rest")).alias("n"))
    return {r["entry"]: np.array([*often.get(r["entry"], (0, 0)), r["n"]], dtype=float) for r in every.collect()}


class Lexicon:
    """Scores of entries, of every other word, and lambda of the scores in the corpus."""

    def __init__(self, counts: dict[str, np.ndarray]):
        names = [e for e in counts if e]
        n_toxic, n_clean, n_all = np.maximum(counts.get("", np.ones(3)), 1)
        table = np.array([counts[e] for e in names]).reshape(-1, 3)
        weight = PRIOR_SHARE * (n_toxic + n_clean)
        prior = weight * table[:, 2] / n_all
        a, b = np.maximum(table[:, 0] + prior, 1e-9), np.maximum(table[:, 1] + prior, 1e-9)
        delta = np.log(a / np.maximum(n_toxic + weight - a, 1e-9)) - np.log(b / np.maximum(n_clean + weight - b, 1e-9))
        z = delta / np.sqrt(1 / a + 1 / b)
        delta *= np.maximum(0.0, 1 - CHANCE_Z ** 2 / np.maximum(z * z, 1e-9))
        self.scores = dict(zip(names, (delta - DRIFT).tolist()))
        self.other = -DRIFT
        # what a text of no toxic kind uses: the whole corpus less the toxic class's share of it
        share = n_toxic / (n_toxic + n_clean)
        plain = np.maximum(table[:, 2] / n_all - share * table[:, 0] / n_toxic, 0.0) / max(1 - share, 1e-9)
        # an entry's own uses: those of no longer entry
        own = dict(zip(names, plain.tolist()))
        for e, p in sorted(zip(names, plain.tolist()), key=lambda t: len(t[0])):
            stem = e.rstrip("*")
            up = next((stem[:k] + "*" for k in reversed(STEMS) if k <= len(stem) and stem[:k] + "*" != e and stem[:k] + "*" in self.scores), None)
            if up:
                own[up] -= p
        shares = np.maximum(np.array([1 - sum(own.values()), *own.values()]), 1e-12)
        self.decay = decay(np.array([self.other, *self.scores.values()]), shares / shares.sum())


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """lambda > 0 with sum(shares * exp(lambda * scores)) = 1 (1 where there is none)."""
    f = lambda x: float(shares @ np.exp(x * scores)) - 1
    if scores.max() <= 0 or shares @ scores >= 0:
        return 1.0
    low, high = 0.0, 1e-3
    while f(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


class WordScores(dict):
    """Score of each word met, by its longest entry; forgets when it grows too large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = self.lexicon.scores
        value = next((found[e] for e in entries(word) if e in found), self.lexicon.other)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, by Ruzzo and
    Tompa; runs of negative scores are crossed in one step."""
    total = np.cumsum(scores)
    hits = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum at end
    for i in hits.tolist():
        first, left, right = i, float(total[i] - scores[i]), float(total[i])
        end = i + 1
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                stack.append((first, end, left, right))
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(f, e, r - l) for f, e, l, r in stack]


SCORED = "doc_id bigint, y int, n_tokens bigint, best double, segments array<struct<first:bigint,end:bigint,score:double>>"


def segments(df: DataFrame, rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, y, n_tokens, best and all maximal segments of every text."""
    sent = common.send(df.sparkSession, lexicon)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(sent())
        for batch in batches:
            for at, texts in byte_slices(batch.column(1).cast(pa.string())):
                codes, ends, names = word_codes(texts)
                value = np.fromiter(map(scores.__getitem__, names), np.float64, len(names))[codes] if names else np.zeros(0)
                best, counts, found = [], [0], []
                for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    segs = maximal_segments(value[s:e])
                    best.append(max((x[2] for x in segs), default=0.0))
                    counts.append(len(segs))
                    found += segs
                table = np.array(found, dtype=float).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(table[:, 0].astype(np.int64)), pa.array(table[:, 1].astype(np.int64)),
                                                    pa.array(table[:, 2])], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ends)), batch.column(2).slice(at, len(ends)), pa.array(np.diff(ends, prepend=0)),
                     pa.array(best, pa.float64()), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), parts)],
                    names=["doc_id", "y", "n_tokens", "best", "segments"])

    return _labelled(df, rows).select("doc_id", "text", "y").mapInArrow(run, SCORED)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def detect(df: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, score and passages (first word, end word, bits) of every row."""
    lexicon = Lexicon(count_entries(df, rows))
    lam = lexicon.decay
    found = common.write_shared(segments(df, rows, lexicon), "segments")
    clean = found.filter("y = 0").agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") * F.exp(-lam * F.col("best"))).alias("s")).first()
    log_k = float(np.log(clean["n"] / clean["s"])) if clean["n"] and clean["s"] else 0.0
    room = F.lit(log_k) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    level = F.transform("segments", lambda s: F.struct(s["first"], s["end"], (lam * s["score"] - room).alias("bits")))
    passages = F.filter(level, lambda s: s["bits"] > SIGNIFICANT)
    shaped = found.select("doc_id", "y", passages.alias("passages"),
                          F.least(F.greatest(lam * F.col("best") - room, F.lit(-10.0)), F.lit(30.0)).alias("x0"),
                          F.log1p(F.aggregate(passages, F.lit(0.0), lambda a, s: a + s["bits"])).alias("x1"))
    # bounded: the training rows
    train = np.array([tuple(r) for r in shaped.filter("y is not null").select("x0", "x1", "y").collect()], dtype=float).reshape(-1, 3)
    if len(set(train[:, 2])) < 2:
        score = F.lit(float(train[:, 2].mean()) if len(train) else 0.0)
    else:
        a, b, c = logistic(train[:, :2], train[:, 2]).tolist()
        score = 1 / (1 + F.exp(-(a * F.col("x0") + b * F.col("x1") + c)))
    return shaped.select("doc_id", score.alias("score"), "passages")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    rows = training_rows(spark, sf_dir, "toxic")
    out = detect(common.documents(spark, sf_dir), rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
