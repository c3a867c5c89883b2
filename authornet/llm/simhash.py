"""SimHash near-duplicates, compared through the anchors of a covering code.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit of their upper or
of their lower half.  The anchors of a half are the code words of the [31, 26] Hamming code over 31 of
its bits: every value lies within covering radius 1 of exactly one anchor, its home.  A value within
one bit of another has that other's home within 1 + 1 = 2 bits, and there are at most 16 anchors that
near.  So every distinct fingerprint is sent home once and replicated to all anchors within radius plus
threshold, per half, and inside an anchor homes are compared with replicas on all 64 bits.

Only distinct fingerprints take part, so exact copies cost one row however many there are.  Inside
an anchor the answer is a spanning forest of the links, never all pairs.  An anchor with more than
``block`` homes is cut: its homes by a hash into blocks, its replicas sent to each of them.

Edge cases: null texts and texts without a word have fingerprint zero, which links like any other;
texts of one or two words are one shingle; an empty table gives an empty result; repeated rows are
copies and keep their row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCK = 4096
CODE_BITS = 31


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased (A-Z) UTF-8 text; bytes.split() cuts at exactly
    0x20 and 0x09-0x0D."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], HASH_SEED) for s, e in zip(starts, stops)], np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, h, fp): fp is the fingerprint as a signed long, h tells texts
    with the same doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.encode(), shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "h", "fp"])

    return common.texts(df).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Syndrome of the 31 code bits: xor of the (1-based) positions that are set."""
    out = np.zeros(len(values), dtype=np.int64)
    for k in range(5):
        mask = np.uint64(sum(1 << i for i in range(CODE_BITS) if (i + 1) >> k & 1))
        odd = np.bitwise_count(values & mask).astype(np.int64) & 1
        out |= odd << k
    return out


def _flips() -> np.ndarray:
    """For each syndrome the flips that reach an anchor: its home first, then those
    two bits away (-1: none; flipping nothing is 0)."""
    table = np.full((32, 16), -1, dtype=np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        table[s, :1 + len(pairs)] = [1 << (s - 1), *pairs]
    return table


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, is home) of all homes and replicas of both halves."""
    flips, index, found, home = _flips(), [], [], []
    for half in (0, 1):
        part = (fps >> np.uint64(32 * half)) & np.uint64((1 << CODE_BITS) - 1)
        flip = flips[_syndromes(part)]
        row, col = np.nonzero(flip >= 0)
        index.append(row)
        found.append((part[row].astype(np.int64) ^ flip[row, col]) | (half << CODE_BITS))
        home.append(col == 0)
    return np.concatenate(index), np.concatenate(found), np.concatenate(home)


def forest(fps: np.ndarray, homes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the homes (indices into ``fps``, which are distinct)
    and all fingerprints: a link is kept where it joins two classes."""
    edges, classes = [], np.arange(len(fps))
    for i in homes:
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits)
        met, first = np.unique(classes[near], return_index=True)
        if len(met) > 1:
            edges += [(int(fps[i]), int(fps[near[k]])) for c, k in zip(met, first) if c != classes[i]]
            classes[np.isin(classes, met)] = met[0]
    return edges


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that hold every class of
    fingerprints within ``max_bits`` together."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves cover distances up to 3 bits")

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            index, anchor, home = anchors(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches):
        """Rows sorted by (anchor, part); a run may cross batches."""
        tail = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            tail = [c[cut:] for c in cols]
            yield from runs([c[:cut] for c in cols])
        if tail is not None:
            yield from runs(tail)

    def runs(cols):
        anchor, part, fp, home = cols
        if not len(anchor):
            return
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.concatenate([new, [len(anchor)]]))
        with_home = np.add.reduceat(home.astype(np.int64), new) > 0
        fps, edges = fp.view(np.uint64), []
        for s, n in zip(new[(sizes > 1) & with_home].tolist(), sizes[(sizes > 1) & with_home].tolist()):
            edges += forest(fps[s:s + n], np.flatnonzero(home[s:s + n]), max_bits)
        if edges:
            pairs = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    rows = distinct.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean")
    rows = common.write_shared(rows, "anchors")
    # anchors with more homes than one task should compare: few, found with partial sums
    hot = (rows.filter("home").groupBy("anchor").agg(F.count("*").alias("homes")).filter(F.col("homes") > block)
           .select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("parts")))
    cut = rows.join(hot, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    parts = (F.when(F.col("parts").isNull(), F.array(F.lit(0)))
             .otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("anchor", "fp", "home", F.explode(parts).alias("part"), F.coalesce(own, F.lit(0)).alias("own"))
    # a home is compared in its own block only; in the others it is a replica
    cut = cut.select("anchor", "part", "fp", (F.col("home") & (F.col("part") == F.col("own"))).alias("home"))
    ready = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return ready.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of every row: root is the smallest fingerprint
    (as a signed long) linked, directly or through others; component_id the smallest doc_id."""
    fps = common.write_shared(fingerprints(df, shingle), "fingerprints")
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(per_fp, max_bits)).select(F.col("node").alias("fp"), "root")
    # written, so that a root or fingerprint shared by many rows is one key of a plain join, which Spark splits
    known = common.write_shared(per_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id"), "roots")
    first = common.write_shared(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "first")
    classes = common.write_shared(known.join(first, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp")


def keep_first(df: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` (all columns) that are the first of their class: smallest doc_id,
    then smallest text hash.  Rows equal in both are one document and stay once, with the other columns of the row whose hash
    is smallest."""
    classes = near_duplicates(df, shingle, max_bits)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key, h, one = (common.free_name(df, x) for x in ("key", "h", "one"))
    first = classes.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    first = first.select(name(F.col("first.doc_id")).alias(key), F.col("first.h").alias(h))
    # equal rows are merged before the shuffle as well as after it; the join keeps the partitioning
    rows = df.withColumns({key: name(F.col("doc_id")), h: F.xxhash64(name(F.col("text")))}).groupBy(key, h).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])).alias(one))
    return rows.join(first, [key, h], "left_semi").select(F.col(f"{one}.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    out = near_duplicates(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
