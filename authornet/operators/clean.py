"""Projections, filters, cleaning and sampling.

All row-wise work is a single projection of built-in expressions; nothing
here shuffles except the explicit sampling operators (P12, P13) and the
batch numbering (P22).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import broadcast_offsets, cut_lineage
from .lexicon import bounded_rows, fits_inline

CLEAN_COLUMNS = ["UID_key", "author", "fwd_message", "fwd_author", "date", "group_or_channel",
                 "own_message", "forwarded_message", "group_name", "fwd_message_string",
                 "final_message", "final_message_string"]


def normalize_author(df: DataFrame, col: str = "author") -> DataFrame:
    """P1."""
    return df.withColumn(col, X.strip_lower(col))


def to_day(df: DataFrame, col: str = "date") -> DataFrame:
    """P2."""
    return df.withColumn(col, F.to_date(F.col(col)))


def flag_own(df: DataFrame) -> DataFrame:
    """Own message when message or transcription is present."""
    return df.withColumn("own_message", F.coalesce("message", "transcribed_message").isNotNull().cast("int"))


def flag_forwarded(df: DataFrame) -> DataFrame:
    """P4."""
    return df.withColumn("forwarded_message", F.col("fwd_message").isNotNull().cast("int"))


def keep_columns(df: DataFrame, cols) -> DataFrame:
    """P5."""
    return df.select(*cols)


def has_any_text(df: DataFrame, cols=("message", "fwd_message", "transcribed_message")) -> DataFrame:
    """Keep rows where any text column is non-null."""
    return df.filter(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


def final_text(df: DataFrame) -> DataFrame:
    """Clean own and forwarded text, pick the final text.  The
    transcription is never cleaned; an emoji-only message stays ''."""
    return (df
            .withColumn("message_string", X.clean_text("message"))
            .withColumn("fwd_message_string", X.clean_text("fwd_message"))
            .withColumn("final_message", F.coalesce("message", "transcribed_message"))
            .withColumn("final_message_string",
                        X.collapse_ws(F.coalesce("message_string", "transcribed_message"))))


def drop_emptied(df: DataFrame) -> DataFrame:
    """Drop a row only when both cleaned texts are exactly ''.

    Catalyst pushes this filter below the cleaning projection, so its
    regexes run once more for the filter.  The forwarded text is tested
    first: it is null for most messages, which short-circuits the ``AND``
    before the own text is cleaned a second time."""
    both_empty = F.coalesce(F.col("fwd_message_string") == "", F.lit(False)) & \
        F.coalesce(F.col("final_message_string") == "", F.lit(False))
    return df.filter(~both_empty)


def clean_messages(raw: DataFrame) -> DataFrame:
    """P1-P11 in one narrow stage: the cleaned message table."""
    df = has_any_text(raw)
    df = to_day(normalize_author(df))
    df = flag_forwarded(flag_own(df))
    df = drop_emptied(final_text(df))
    return df.select(*CLEAN_COLUMNS)


def _hash_order(seed: int, key: str) -> Column:
    """Seeded, engine-portable pseudo-random order: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _under(seed: int, key: str, share: Column) -> Column:
    """True where the seeded hash of the key lies in the first ``share`` of all hashes."""
    return F.conv(F.substring(_hash_order(seed, key), 1, 8), 16, 10).cast("double") < share * F.lit(float(1 << 32))


def _enough(wanted: Column, of: Column, slack: float) -> Column:
    """A share of ``of`` rows that holds ``wanted`` of them but for a chance of about e^-50 (at slack 1)."""
    return F.least(F.lit(1.0), slack * (wanted + 10 * F.sqrt(wanted.cast("double")) + 100) / F.greatest(of, F.lit(1)))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "UID_key") -> DataFrame:
    """Repeatable sample of exactly ``n`` rows (fewer if the input is
    smaller), the first n in seeded-hash order; ``key`` names a row, rows without one are left out.  Sampling *is* the
    operator here, so the cut is the feature.  Only keys whose hash lies under a threshold that n and the number
    of rows give are sorted, about n of them; the chosen keys pick the rows in a semi-join.  Should chance leave too few, the
    threshold is raised."""
    keys = df.filter(F.col(key).isNotNull()).select(key)
    total, slack = keys.count(), 1.0
    while True:
        share = _enough(F.lit(n), F.lit(total), slack)
        near = keys.filter(_under(seed, key, share)).select(F.struct(_hash_order(seed, key).alias("h"), F.col(key).alias("k")).alias("_order"))
        positions = row_positions(near, "_order")
        if positions.count() >= min(n, total):
            chosen = positions.filter(F.col("_pos") <= n)
            return df.join(chosen.select(F.col("_order.k").alias(key)), key, "left_semi")
        slack *= 4


def sample_clean(raw: DataFrame, n: int, seed: int = 42, buffer: int = 500, key: str = "UID_key") -> DataFrame:
    """P12 as a pipeline step: sample n + buffer messages that have any
    text, clean them, then keep n of the survivors (the buffer covers rows
    that cleaning empties)."""
    pre = sample_n(has_any_text(raw), n + buffer, seed, key)
    return sample_n(clean_messages(pre), n, seed, key)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: str = "UID_key") -> DataFrame:
    """P12 fraction mode: keep a row when its seeded hash falls under the
    fraction (repeatable, no shuffle)."""
    u = F.conv(F.substring(_hash_order(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.filter(u < F.lit(fraction))


def sample_balanced(df: DataFrame, n: int, by: str = "group_or_channel", seed: int = 42,
                    key: str = "UID_key") -> DataFrame:
    """N rows split evenly over the strata of ``by``; a stratum that has
    too few rows gives its shortfall to the others (water-filling).  Of each stratum only the keys under a hash threshold
    (see :func:`sample_n`) are ordered, about as many as it gives: a key's number in its stratum is its position among
    all of them minus the stratum's first one, so a stratum holding most rows is never
    sorted in one task; the chosen keys then pick the rows in a semi-join.  Rows without
    a stratum cannot be allotted and are left out, as are rows without a key."""
    keys = df.filter(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by).alias("s"), F.col(key).alias("k"))
    strata = cut_lineage(water_fill(keys.groupBy("s").agg(F.count(F.lit(1)).alias("cnt")), n))
    slack = 1.0
    while True:
        share = _enough(F.col("quota"), F.col("cnt"), slack)
        near = keys.join(strata, "s").filter(_under(seed, "k", share))
        pos = row_positions(near.select(F.struct("s", _hash_order(seed, "k").alias("h"), "k").alias("_order")), "_order")
        held = pos.groupBy(F.col("_order.s").alias("s")).agg(F.min("_pos").alias("first"), F.count(F.lit(1)).alias("held"))
        ranges = cut_lineage(strata.join(held, "s", "left"))
        if not ranges.filter(F.coalesce("held", F.lit(0)) < F.least("quota", "cnt")).limit(1).count():
            chosen = (pos.join(ranges.select("s", "first", "quota"), F.col("_order.s") == F.col("s"))
                      .filter(F.col("_pos") - F.col("first") < F.col("quota")))
            return df.join(chosen.select(F.col("_order.k").alias(key)), key, "left_semi")
        slack *= 4


def water_fill(strata: DataFrame, n: int) -> DataFrame:
    """``strata`` (s, cnt, ...) with ``quota``: even shares of n; strata smaller than
    their share give the rest to the larger ones (smallest first, what does not divide to
    the largest).  With the strata in order of size, the i-th of m is taken
    whole as long as its count is at most (n - rows before it) // (m - i); from the
    first larger one on, all share what is left."""
    from .stats import _cumulative_before
    rank = row_positions(strata.select(F.struct("cnt", F.col("s").cast("string").alias("name")).alias("_o"), "s", "cnt"), "_o", "_i")
    ranked = _cumulative_before(rank.withColumn("_g", F.lit(1)), ["_g"], "_i", "cnt").select(
        "s", "cnt", (F.col("_i") - 1).alias("i"), F.col("before").alias("_before"))
    m = ranked.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    share = F.floor((F.lit(n) - F.col("_before")) / (F.lit(m) - F.col("i")))
    cut = ranked.filter(F.col("cnt") > share).agg(F.min(F.struct("i", "_before")).alias("x")).first()["x"]
    whole = F.col("cnt")
    if cut is None:
        quota = whole
    else:
        base, extra = divmod(max(n - cut["_before"], 0), m - cut["i"])
        quota = F.when(F.col("i") < cut["i"], whole).otherwise(
            F.lit(base) + (F.col("i") >= m - extra).cast("long"))
    return strata.join(ranked.select("s", quota.cast("long").alias("quota")), "s")


def union_tagged(frames: dict, tag_col: str = "group_or_channel") -> DataFrame:
    """Tag each source and union by name (missing columns are null)."""
    tagged = [df.withColumn(tag_col, F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def own_only(df: DataFrame) -> DataFrame:
    """P15."""
    return df.filter(F.col("own_message") == 1)


def one_hot(df: DataFrame, col: str, values, prefix: str | None = None) -> DataFrame:
    """0/1 column per known value (an absent value yields zeros)."""
    prefix = prefix if prefix is not None else col + "_"
    return df.withColumns({f"{prefix}{v}": (F.col(col) == F.lit(v)).cast("int") for v in values})


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """P17."""
    return df.withColumnsRenamed(mapping)


def recode(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Value lookup through a literal map; unmapped values become null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or col, F.element_at(m, F.col(col)))


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """P19."""
    return df.fillna(0, subset=list(cols))


def assemble(df: DataFrame, cols, out: str = "x", keep=("author",)) -> DataFrame:
    """P20: null-as-zero feature array in a fixed column order, keyed by
    author (never by position)."""
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return df.select(*keep, arr.alias(out))


def batch_ids(df: DataFrame, size: int, order: str = "UID_key", out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order`` (a unique key).
    Positions of the keys alone are computed without a single-partition window: a
    range-partitioned sort, per-partition counts, then offsets added back per partition."""
    pos = row_positions(df.select(order), order)
    batch = pos.select(order, F.floor((F.col("_pos") - 1) / F.lit(size)).cast("bigint").alias(out))
    return df.join(batch, order)


def row_positions(df: DataFrame, order: str, out: str = "_pos") -> DataFrame:
    """1-based global position in ``order`` (ties broken by the column
    itself), built from per-partition counts rather than one global window."""
    sorted_df = df.repartitionByRange(order).sortWithinPartitions(order)
    # pin the partition ids: both branches below must see the same ones
    part = cut_lineage(sorted_df.withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (part.withColumn("_local", local)
            .join(broadcast_offsets(offsets), "_part")
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_part", "_local", "_off"))


def preprocess_text(df: DataFrame, col: str, stopwords, lemmas: DataFrame, out: str = "preprocessed",
                    key: str = "UID_key") -> DataFrame:
    """Lower-case word tokens, stop-words dropped, lemma substituted,
    re-joined with ' '.  A lemma table measured small travels as a map and all happens inside the row;
    a larger one is joined to the tokens, and each row is rebuilt from its tokens' positions.  Of several
    lemmas of one word the first in order is taken."""
    table = lemmas.select("word", "lemma").dropna()
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))]).cast("array<string>")
    words = F.filter(X.words_array(col), lambda w: ~F.array_contains(stop, w))
    if not fits_inline(table):
        # rows are numbered here and stored, so that keys may repeat or be null
        base = cut_lineage(df.withColumns({"_row": F.monotonically_increasing_id(), "_words": words}))
        tokens = base.select("_row", F.posexplode("_words").alias("pos", "word"))
        found = tokens.join(table.groupBy("word").agg(F.min("lemma").alias("lemma")), "word", "left")
        placed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("w"))))
        rebuilt = found.groupBy("_row").agg(F.array_join(F.transform(placed, lambda x: x["w"]), " ").alias("_text"))
        return (base.join(rebuilt, "_row", "left").withColumn(out, F.coalesce("_text", F.lit("")))
                .drop("_row", "_words", "_text"))
    lem = {r["word"]: r["lemma"] for r in sorted(bounded_rows(table), reverse=True)}
    known = F.create_map(*[F.lit(x) for pair in sorted(lem.items()) for x in pair]) if lem else None
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)) if lem else words
    return df.withColumn(out, F.coalesce(F.array_join(mapped, " "), F.lit("")))
