"""Packing token documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder shorter than a window.  All that
matters about the remainders is how many there are of each length: a table of at most
``window - 1`` counts, whatever the corpus.  The planner fills window after window from that
multiset: it takes the longest length left and asks a bitset subset sum over the others for the
multiset that comes closest to the capacity (the least slack), reads the counts of each length
back from the bitsets, and uses the multiset as often as the counts allow.  Where even the best
multiset leaves slack, the remainders of that length go to a pool whose members are laid end to
end and cut at window borders, so only the very last sequence can be short.

Which document fills which place follows from its rank among remainders of equal length:
rank = remainders of that length in earlier blocks + rank inside its block.  Blocks are the tasks
that tokenised the texts; their counts are summed with a two-level prefix sum.  Nothing but the
table of counts reaches the driver, and only the plan (``segments``, bounded by the number of
lengths) is broadcast.

Edge cases: a null or empty text is one end id; an empty table gives an empty result; repeated
rows and repeated doc_ids are separate documents (``row_id`` tells them apart); texts longer than
a window fill whole windows first; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import byte_slices, encoder

WINDOW = 2048
END_ID = 1

RANKED = "doc_id bigint, h bigint, block int, row_in_block bigint, n_tokens bigint, n_full bigint, rest int, full_rank bigint, rest_rank bigint"


def tokenize(df: DataFrame, tokenizer_path: str, spaced: bool, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The ranks in its block of each whole text's ids (with ``end_id`` behind them), and the
    ids themselves or, without ``with_ids``, the crc32 of each full window and of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, spaced)
        block = TaskContext.get().partitionId()
        row, full_seen, rest_seen = 0, 0, np.zeros(window, dtype=np.int64)
        for batch in batches:
            doc_ids, hashes = batch.column(0), batch.column(2)
            for at, texts in byte_slices(batch.column(1).cast(pa.string())):
                flat, ends = enc.encode_ended(texts, end_id)
                raw, stops = memoryview(flat.astype("<u4")).cast("B"), (4 * ends).tolist()
                ids = [raw[s:e] for s, e in zip([0, *stops], stops)]
                n = np.diff(ends, prepend=0)
                full, rest = n // window, n % window
                ranks = np.empty(len(n), dtype=np.int64)
                for i, r in enumerate(rest.tolist()):
                    ranks[i] = rest_seen[r]
                    rest_seen[r] += 1
                full_before = full_seen + np.cumsum(full) - full
                if with_ids:
                    last, names = [pa.array([bytes(x) for x in ids], type=pa.binary())], ["ids"]
                else:
                    step = 4 * window
                    heads = [[zlib.crc32(x[k * step:(k + 1) * step]) for k in range(f)] for x, f in zip(ids, full.tolist())]
                    rests = [zlib.crc32(x[f * step:]) if f else zlib.crc32(x) for x, f in zip(ids, full.tolist())]
                    last, names = [pa.array(heads, pa.list_(pa.int64())), pa.array(rests, pa.int64())], ["full_crcs", "rest_crc"]
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(at, len(n)), hashes.slice(at, len(n)), pa.array(np.full(len(n), block, dtype=np.int32)),
                    pa.array(np.arange(row, row + len(n))), pa.array(n), pa.array(full),
                    pa.array(rest.astype(np.int32)), pa.array(full_before), pa.array(ranks), *last],
                    names=["doc_id", "h", "block", "row_in_block", "n_tokens", "n_full", "rest", "full_rank", "rest_rank", *names])
                row, full_seen = row + len(n), full_seen + int(full.sum())

    schema = RANKED + (", ids binary" if with_ids else ", full_crcs array<bigint>, rest_crc bigint")
    return df.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def best_fill(counts: np.ndarray, room: int) -> tuple[int, dict[int, int]]:
    """The multiset of lengths (each at most ``counts`` times) whose sum comes
    closest to ``room`` from below: (sum, {length: times}).  Bit s of a bitset says that the
    lengths looked at so far can sum to s; counts are split into powers of two, and the
    bitset before each step is kept to read the choice back."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        times = 1
        while left > 0:
            k = min(times, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    at, chosen = total, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:  # reached only with this step
            chosen[length] = chosen.get(length, 0) + k
            at -= k * length
    return total, chosen


def plan_windows(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple], int]:
    """``counts[l]``: remainders of length l.  Returns (segments, windows used).
    A segment ``(length, lo, hi, first, times, offset, pool)`` places the remainders of that
    length with ranks lo..hi-1: ``times`` to a window from window ``first`` on at ``offset``;
    or, with ``pool`` >= 0, end to end from that position of the cut pool."""
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
    left[0] = 0
    segments, pool, windows = [], [], 0
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            left[longest] -= 1
            total, chosen = best_fill(left, window - longest)
            left[longest] += 1
            if total < window - longest:  # no multiset fits: this length is cut
                pool.append(longest)
                break
            chosen[longest] = chosen.get(longest, 0) + 1
            repeat = min(int(left[x]) // t for x, t in chosen.items())
            offset = 0
            for length, times in sorted(chosen.items(), reverse=True):
                taken = repeat * times
                segments.append((length, int(used[length]), int(used[length]) + taken, windows, times, offset, -1))
                used[length] += taken
                left[length] -= taken
                offset += times * length
            windows += repeat
        if pool and pool[-1] == longest:
            segments.append((longest, int(used[longest]), int(used[longest] + left[longest]), 0, 1, 0, 0))
            used[longest] += left[longest]
            left[longest] = 0
    at, placed = 0, []
    for s in segments:
        if s[6] >= 0:
            s = (*s[:6], at)
            at += s[0] * (s[2] - s[1])
        placed.append(s)
    return placed, windows + -(-at // window)


SEGMENTS = T.StructType([T.StructField("rest", T.IntegerType()), T.StructField("segments", T.ArrayType(
    T.StructType([T.StructField(x, T.LongType()) for x in ("lo", "hi", "first", "times", "offset", "pool")])))])


def _placed(rank: Column, length: Column, seg: Column, pool_first: int, window: int) -> Column:
    """Pieces of one remainder as structs (begin, length, sequence_id, offset); begin
    counts from the remainder's first id."""
    nth = rank - seg["lo"]
    at = seg["pool"] + nth * length
    head = F.least(length, F.lit(window) - at % window)

    def piece(begin, size, sequence, offset):
        return F.struct(begin.cast("long").alias("begin"), size.cast("long").alias("size"),
                        sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    whole = piece(F.lit(0), length, seg["first"] + F.floor(nth / seg["times"]),
                  seg["offset"] + nth % seg["times"] * length)
    cut = [piece(F.lit(0), head, pool_first + F.floor(at / window), at % window),
           piece(head, length - head, pool_first + F.floor(at / window) + 1, F.lit(0))]
    return (F.when(seg["pool"] < 0, F.array(whole)).when(head < length, F.array(*cut)).otherwise(F.array(cut[0])))


def place(tokens: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """``tokens``: a written result of :func:`tokenize`.  One row per document: block, row_in_block,
    ``keep`` and ``pieces``, an array of (start, length, sequence_id, offset)."""
    spark = tokens.sparkSession
    narrow = tokens.select("block", "row_in_block", "n_full", "rest", "full_rank", "rest_rank", *keep)
    counts = narrow.groupBy("block", "rest").agg(F.count("*").alias("n"), F.sum("n_full").alias("full")).persist()
    table = np.zeros(window, dtype=np.int64)
    # at most ``window`` rows, whatever the corpus
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        table[r["rest"]] = r["n"]
    segments, windows = plan_windows(table, window)
    pool_first = max((s[3] + -(-(s[2] - s[1]) // s[4]) for s in segments if s[6] < 0), default=0)
    by_length: dict[int, list] = {}
    for length, *seg in segments:
        by_length.setdefault(length, []).append(tuple(seg))
    # bounded: each use of a multiset exhausts a length, so there are at most 2 * window multisets
    plan = spark.createDataFrame(sorted(by_length.items()), SEGMENTS)
    starts = common.exclusive_prefix(counts.select("block", "rest", "n"), "block", "n", "rest_start", by=("rest",))
    blocks = counts.groupBy("block").agg(F.sum("full").alias("full"))
    fulls = common.exclusive_prefix(blocks, "block", "full", "full_start").select("block", "full_start")
    starts = starts.join(fulls, "block").select("block", "rest", "rest_start", "full_start")
    ranked = (narrow.join(starts, ["block", "rest"]).join(F.broadcast(plan), "rest", "left")
              .withColumn("rank", F.col("rest_rank") + F.col("rest_start"))
              .withColumn("seg", F.filter("segments", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))))
    seg = F.element_at("seg", 1)
    rest_start = F.col("n_full") * window
    full = F.transform(F.when(F.col("n_full") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1))
                       .otherwise(F.array().cast("array<bigint>")),
                       lambda k: F.struct((k * window).alias("start"), F.lit(window).cast("long").alias("length"),
                                          (F.lit(windows) + F.col("full_start") + F.col("full_rank") + k).cast("long")
                                          .alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    tail = F.transform(F.when(F.col("rest") > 0, _placed(F.col("rank"), F.col("rest"), seg, pool_first, window))
                       .otherwise(F.array().cast("array<struct<begin:bigint,size:bigint,sequence_id:bigint,offset:bigint>>")),
                       lambda p: F.struct((rest_start + p["begin"]).alias("start"), p["size"].alias("length"),
                                          p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")))
    return ranked.select("block", "row_in_block", *keep, F.concat(full, tail).alias("pieces"))


def pack(df: DataFrame, tokenizer_path: str, spaced: bool = False, end_id: int = END_ID,
         window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (binary, little-endian unsigned 32-bit), row_id."""
    tokens = common.write_shared(tokenize(common.texts(df), tokenizer_path, spaced, end_id, window), "tokens")
    placed = place(tokens, window)
    return (tokens.select("doc_id", "block", "row_in_block", "n_tokens", "ids").join(placed, ["block", "row_in_block"])
            .select("doc_id", "block", "row_in_block", "n_tokens", "ids", F.explode("pieces").alias("p"))
            .select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"),
                    F.col("n_tokens").alias("doc_tokens"), F.col("p.sequence_id").alias("sequence_id"),
                    F.col("p.offset").alias("offset"),
                    F.expr("substring(ids, int(p.start * 4 + 1), int(p.length * 4))").alias("ids"),
                    F.shiftleft(F.col("block").cast("long"), 40).bitwiseOR(F.col("row_in_block")).alias("row_id")))


def digests(df: DataFrame, tokenizer_path: str, spaced: bool = False, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """The pieces of :func:`pack` with the crc32 of their ids instead of the ids: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset.  Ids are summed where they are made and
    never leave their task; only documents whose remainder is cut are encoded a second time."""
    texts = common.texts(df)
    tokens = common.write_shared(tokenize(texts, tokenizer_path, spaced, end_id, window, with_ids=False), "tokens")
    kept = ("doc_id", "h", "n_tokens", "full_crcs", "rest_crc")
    placed = place(tokens, window, (*kept, F.col("rest").alias("size"), F.col("n_full").alias("whole")))
    p = F.col("p")
    crc = (F.when(p["start"] < F.col("whole") * window, F.get("full_crcs", (p["start"] / window).cast("int")))
           .when(p["length"] == F.col("size"), F.col("rest_crc")))
    cut = F.size(F.filter("pieces", lambda x: (x["start"] >= F.col("whole") * window) & (x["length"] < F.col("size")))) > 0
    rows = common.write_shared(placed.select(*kept, "size", "whole", "pieces", cut.alias("cut")), "placed")
    # equal texts with equal ids are cut alike below, so (doc_id, h) is name enough; the written
    # list has a known size, by which the planner takes a broadcast or a shuffle join
    again = common.write_shared(rows.filter("cut").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "h").distinct(), "cut")
    named = texts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    second = named.join(again, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("doc_id", "text")
    ids = tokenize(second, tokenizer_path, spaced, end_id, window).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "h", "ids")
    piece = [F.col("n_tokens").alias("doc_tokens"), p["start"].alias("start"), p["length"].alias("length"),
             p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")]
    plain = rows.filter("not cut").withColumn("p", F.explode("pieces")).select("doc_id", crc.alias("ids_crc32"), *piece)
    bits = F.expr("crc32(substring(ids, int(p.start * 4 + 1), int(p.length * 4)))")
    recut = (rows.filter("cut").withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(ids, ["k", "h"])
             .withColumn("p", F.explode("pieces")).select("doc_id", bits.alias("ids_crc32"), *piece))
    return plain.unionByName(recut)


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The packing query over all documents (one row per piece)."""
    import public_tokenizers

    pieces = digests(common.documents(spark, sf_dir), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
