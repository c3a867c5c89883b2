"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, lowest first.  Level k of a segment holds chunk k of every id that
has one, with a bitmap telling which of them continue on level k + 1, and a directory with the
number of set bits before each 512th.  Token i of a segment is found by one byte and one rank per
level, without decoding a block.

A segment is one row of a Parquet table: (part, nth, first_start, n_docs, n_ids, payload).  Parts are
ranges of doc_id, so segments in (part, nth) order hold the documents in ascending doc_id order.
Spark's own writer commits the files, so any store it can write will do and a lost executor
leaves nothing half written.

Edge cases: null and empty texts are one end id; an empty table gives an empty result; rows that
repeat a doc_id follow each other, ordered by a hash of their text; a document longer than a
segment gets one of its own; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import byte_slices, encoder

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_IDS = 1 << 20
END_ID = 0
SEGMENT_SCHEMA = "part int, nth int, n_docs bigint, n_ids bigint, payload binary"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation flags) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, document directory (ids and first tokens), then the levels."""
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    levels = encode_levels(ids)
    out = [struct.pack("<4sIQB", MAGIC, len(doc_ids), len(ids), len(levels)), known.tobytes(), keys.tobytes(), starts.tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        edges = np.arange(0, len(more), RANK_BITS)
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.int64), edges))[:-1]]) if len(more) else edges
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """A view of one payload; nothing is decoded before it is asked for."""

    def __init__(self, payload: bytes):
        magic, n_docs, self.n_ids, n_levels = struct.unpack_from("<4sIQB", payload)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = struct.calcsize("<4sIQB")
        self.known = np.frombuffer(payload, np.uint8, n_docs, at)
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at + n_docs)
        self.starts = np.frombuffer(payload, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)
        at += 9 * n_docs + 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            n_bits, n_ranks = -(-n // 8), -(-n // RANK_BITS)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + 8 + n)
            ranks = np.frombuffer(payload, "<u8", n_ranks, at + 8 + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + n_bits + 8 * n_ranks

    def token(self, i: int) -> int:
        """Token ``i`` alone: a byte and a rank on each level it reaches."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            first = i // RANK_BITS * RANK_BITS
            inside = np.unpackbits(bits[first >> 3:(i >> 3) + 1], bitorder="little")[:i - first]
            i = int(ranks[i // RANK_BITS]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every token: each level's chunks go to their byte of the tokens that
        reach it."""
        out = np.zeros((self.n_ids, 4), dtype=np.uint8)
        reach = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if k == 0:
                out[:, 0] = chunks
            else:
                out[reach, k] = chunks
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            reach = more if reach is None else reach[more]
        return out.view("<u4").ravel()


def write_tokens(df: DataFrame, tokenizer_path: str, spaced: bool = True, end_id: int = END_ID,
                 segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts and write the segments; returns the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, spaced)
        part, nth = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (lengths, ids)
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, docs, parts, held
            lengths, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(docs)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([encode_segment(docs, lengths, ids)], pa.binary())],
                names=["part", "nth", "n_docs", "n_ids", "payload"])
            docs, parts, held, nth = [], [], 0, nth + 1
            return row

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in byte_slices(batch.column(1).cast(pa.string())):
                ids, ends = enc.encode_ended(texts, end_id)
                starts, first = np.concatenate([[0], ends[:-1]]), 0
                while first < len(ends):  # up to the document that fills the segment
                    last = min(len(ends), int(np.searchsorted(ends, starts[first] + segment_ids - held)) + 1)
                    docs += keys[at + first:at + last]
                    parts.append((ends[first:last] - starts[first:last], ids[starts[first]:ends[last - 1]]))
                    held += int(ends[last - 1] - starts[first])
                    first = last
                    if held >= segment_ids:
                        yield flush()
        if docs:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]
    # the row number only spreads rows that are equal in both over several parts
    ranged = (common.texts(df).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order, "row").sortWithinPartitions(*order, "row"))
    return common.write_shared(ranged.select("doc_id", "text").mapInArrow(run, SEGMENT_SCHEMA), "dac")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document in file order: doc_id, start (tokens of all documents before
    it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seg = Segment(payload)
                raw = memoryview(seg.all()).cast("B")
                starts = seg.starts
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, mask=seg.known == 0), pa.array([part] * n, pa.int32()),
                     pa.array([nth] * n, pa.int32()), pa.array(starts[:-1]), pa.array(np.diff(starts)),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "nth", "inside", "n_tokens", "ids_crc32"])

    docs = files.select("part", "nth", "payload").mapInArrow(
        run, "doc_id bigint, part int, nth int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    ordered = files.select("part", "nth", "n_ids", (F.col("part").cast("long") * common.PREFIX_FANOUT ** 2
                                                   + F.col("nth")).alias("order"))
    starts = common.exclusive_prefix(ordered, "order", "n_ids", "first").select("part", "nth", "first")
    return docs.join(starts, ["part", "nth"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: ``wanted`` (part, nth, i) -> token, decoding no block."""

    def run(key, left, right):
        import pandas as pd

        seg = Segment(left["payload"].iloc[0]) if len(left) else None
        values = [seg.token(int(i)) if seg and 0 <= i < seg.n_ids else None for i in right["i"]]
        return pd.DataFrame({"part": right["part"], "nth": right["nth"], "i": right["i"],
                             "token": pd.array(values, dtype="Int64")})

    asked = wanted.select("part", "nth", "i").distinct()
    return (files.join(asked.select("part", "nth").distinct(), ["part", "nth"], "left_semi")
            .groupBy("part", "nth").cogroup(asked.groupBy("part", "nth"))
            .applyInPandas(run, "part int, nth int, i bigint, token bigint"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents written as segments and read back (one row per document)."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return read_tokens(write_tokens(common.documents(spark, sf_dir), path))
