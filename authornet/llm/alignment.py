"""Alignment of two tokenizers' tokens on the same bytes.

Tokens of A and B that end at the same byte cut a text into groups.  The cuts are found by divide and conquer: the
end of A's token nearest the middle that bisection also finds among B's ends splits the interval, both halves go on
alike, and an interval without such an end is a group.  Every end is probed once, however the cuts lie.

Both vocabularies break a text before a single space (and at a single line end) whatever stands around it, so texts are
cut there into units, and a unit's tokens do not depend on its neighbours.  A task encodes and aligns the units it has
not met, many in one stream; documents are then sums and concatenations over their units.  Texts or vocabularies
for which that does not hold are one unit each.

Spark does the corpus-wide part: a task writes chunks (bounded by text bytes) with the distinct units of the chunk and
the id pairs they link; pairs are summed over chunks, compared with the highest of their B id, and joined
back to the chunks, which turn them into sums per document.

Edge cases: null and empty texts, and texts whose joined token bytes differ from space + text, have zeros and an empty
groups_sha256, and their links count nowhere; repeated rows count each; a text longer than a chunk is a chunk of its own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import LINE_END, MARKS, byte_slices, cut_pieces, marked, per_worker

# A chunk is one row: what a worker and the JVM hold of it at once is a few dozen times its text.
CHUNK_BYTES = 2 << 20
# Units that a worker keeps; the table starts anew beyond that.
CACHE_UNITS = 400_000
# Units encoded in one call (long calls cost more a byte) and aligned in one stream.
CALL_UNITS, STREAM_UNITS = 1_000, 16_000
JOIN_UNITS = 1 << 18


def split_groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ends of the groups as rows (tokens of A so far, tokens of B so far); ``a`` and ``b`` are the ascending byte ends
    of the tokens of the same bytes, so the last ones agree.  All open intervals take a step together, which probes the end
    nearest their middle that was not probed yet."""
    done = []
    # tokens a0 .. a1 and b0 .. b1 of an interval, its ends low .. high of A that may be cuts, those from
    # below to above (around the middle) probed in vain
    middle = (len(a) - 1) // 2
    todo = np.array([[0, len(a), 0, len(b), 0, len(a) - 1, middle, middle]])
    while len(todo):
        a0, a1, b0, b1, low, high, below, above = todo.T
        leaf = (a1 - a0 == 1) | (b1 - b0 == 1) | ((above >= high) & (below <= low))
        done.append(todo[leaf][:, [1, 3]])
        a0, a1, b0, b1, low, high, below, above = todo = todo[~leaf].T
        up = (above < high) & (((above - below) % 2 == 0) | (below <= low))
        at = np.where(up, above, below - 1)
        found = np.searchsorted(b, a[at])
        hit = b[found] == a[at]
        # without a hit the probe joins those in vain; with one the interval falls into halves, whose ends lie beyond them
        missed = np.stack([a0, a1, b0, b1, low, high, np.where(up, below, at), np.where(up, at + 1, above)], axis=1)[~hit]
        left = np.stack([a0, at + 1, b0, found + 1, low, np.where(up, below, at)], axis=1)[hit]
        right = np.stack([at + 1, a1, found + 1, b1, np.where(up, at + 1, above), high], axis=1)[hit]
        halves = np.concatenate([left, right])
        middle = np.maximum(halves[:, 4:5], halves[:, 4:6].sum(axis=1, keepdims=True) // 2)
        todo = np.concatenate([missed, np.concatenate([halves, middle, middle], axis=1)])
    out = np.concatenate(done)
    return out[np.argsort(out[:, 0])]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of A and B whose bytes overlap: between two neighbouring ends (of either) there
    is one token of each, and no pair meets twice."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Aligner:
    """Both tokenizers and the units met so far, as rows of a table: ``text`` (their groups), ``sizes`` (n_a, n_b, n_groups,
    n_links, 1 where both token sequences give back the bytes) and ``codes`` (their links as pair codes, one after the other)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            known = all(c in plain for c in piece)
            self.bytes_a[i] = bytes(plain[c] for c in piece) if known else piece.encode()
        self.bytes_b = []
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        for i, piece in enumerate(pieces):
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.names = [pa.array([str(i) for i in range(n)]) for n in (len(self.bytes_a), len(self.bytes_b))]
        whole = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # a unit stands alone if no piece holds a space after another character, nor a line end
        self.cut = all("▁" not in p.lstrip("▁") and "\n" not in p for p in whole)
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.string())
        self.text = pa.array([], pa.string())
        self.sizes = np.zeros((0, 5), dtype=np.int32)
        self.codes = np.zeros(0, dtype=np.int64)

    def _stream(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + ``text``, where both give back its bytes."""
        raw = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def _encode(self, units: list[str], out: list) -> None:
        """Append (units, ids of A, ids of B) of calls with many units; single ones without tokens have none."""
        # a first word of their own: a line end must not open the stream
        texts = [("\n" if u[0] == LINE_END else " ") + u[1:] if u.startswith(MARKS) else " " + u for u in units]
        stream = self._stream("x" + "".join(texts))
        if stream is not None:
            out.append((units, [len(t.encode()) for t in texts], *stream))
        elif len(units) == 1:
            out.append((units, None, None, None))
        else:
            for at in (0, 1):
                self._encode(units[at::2], out)

    def learn(self, units: list[str]) -> list[tuple]:
        """Encode units, many in a call, and align all of them as one stream: (units, text, sizes, codes) as in the table."""
        parts: list = []
        blank = {u for u in units if not u or u[-1].isspace()}  # the next unit's space would join theirs
        for u in blank:
            self._encode([u], parts)
        inner = [u for u in units if u not in blank] if blank else units
        for at in range(0, len(inner), CALL_UNITS):
            self._encode(inner[at:at + CALL_UNITS], parts)
        bad = [p[0][0] for p in parts if p[1] is None]
        out = [(bad, pa.array([""] * len(bad), pa.string()), np.zeros((len(bad), 5), np.int32), np.zeros(0, np.int64))]
        parts = [p for p in parts if p[1] is not None]
        if not parts:
            return out
        ids_a, ids_b = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        names = [u for p in parts for u in p[0]]
        # byte ends of the units; two bytes (" x") before the first one of each call belong to none
        edges = np.cumsum(np.concatenate([[2, *p[1]] for p in parts]))
        lone = np.cumsum([0] + [len(p[1]) + 1 for p in parts[:-1]])
        groups = np.concatenate([np.zeros((1, 2), np.int64), split_groups(ends_a, ends_b)])
        at_group = np.searchsorted(ends_a[groups[1:, 0] - 1], edges, side="right")
        link_a, link_b = links(ends_a, ends_b)
        at_link = np.searchsorted(np.minimum(ends_a[link_a], ends_b[link_b]), edges, side="right")
        text = pc.binary_join_element_wise(*[
            pc.binary_join(pa.ListArray.from_arrays(pa.array(groups[:, k], pa.int32()), self.names[k].take(pa.array(ids))), ",")
            for k, ids in ((0, ids_a), (1, ids_b))], "|")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at_group]), pa.int32()), text), ";")
        own = np.delete(np.arange(len(edges)), lone)
        tokens = groups[at_group]
        sizes = np.concatenate([tokens[own] - tokens[own - 1], (at_group[own] - at_group[own - 1])[:, None],
                                (at_link[own] - at_link[own - 1])[:, None], np.ones((len(own), 1), np.int64)], axis=1)
        keep = np.ones(len(link_a), dtype=bool)
        for i in lone.tolist():
            keep[(at_link[i - 1] if i else 0):at_link[i]] = False
        out.append((names, joined.take(pa.array(own)), sizes.astype(np.int32), ((ids_a[link_a] << 32) | ids_b[link_b])[keep]))
        return out

    def _append(self, learnt: list[tuple]) -> None:
        names, text, sizes, codes = zip(*learnt)
        self.keys = pa.concat_arrays([self.keys, *(pa.array(n, pa.string()) for n in names)])
        self.text = pa.concat_arrays([self.text, *text])
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.codes = np.concatenate([self.codes, *codes])

    def values(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(groups text, sizes, links one after the other) of distinct units."""
        if len(self.keys) > CACHE_UNITS or len(self.codes) > 8 * CACHE_UNITS:
            self._forget()
        at = pc.index_in(units, value_set=self.keys)
        absent = pc.is_null(at)
        if pc.any(absent).as_py():
            known, new = len(self.keys), units.filter(absent)
            self._append([x for k in range(0, len(new), STREAM_UNITS) for x in self.learn(new.slice(k, STREAM_UNITS).to_pylist())])
            at = pc.replace_with_mask(at, absent, pc.add(pc.index_in(new, value_set=self.keys.slice(known)), pa.scalar(known, pa.int32())))
        rows = at.to_numpy()
        sizes = self.sizes[rows]
        starts = (np.cumsum(self.sizes[:, 3], dtype=np.int64) - self.sizes[:, 3])[rows]
        ends = np.cumsum(sizes[:, 3], dtype=np.int64)
        flat = np.repeat(starts - (ends - sizes[:, 3]), sizes[:, 3]) + np.arange(ends[-1] if len(ends) else 0)
        return self.text.take(pa.array(rows)), sizes, self.codes[flat]


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


CHUNK_SCHEMA = ("chunk bigint, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, "
                "sha: string, size: int>>, codes binary, unit_pairs binary, unit_sizes binary, pairs array<bigint>, counts array<bigint>")
DOC = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                 ("sha", pa.string()), ("size", pa.int32())])


def group_hashes(text: pa.Array, codes: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups: the text of its units, joined by ``;``.  At most JOIN_UNITS units are joined at once."""
    out, first = [], 0
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + JOIN_UNITS, side="right")))
        if ends[last - 1] - starts[first] <= JOIN_UNITS:
            lo, hi = starts[first], ends[last - 1]
            cuts = np.concatenate([starts[first:last], [hi]]) - lo
            rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text.take(pa.array(codes[lo:hi])))
            out += [hashlib.sha256(t.as_buffer()).hexdigest() for t in pc.binary_join(rows, ";")]
        else:  # one long document
            state = hashlib.sha256()
            for at in range(starts[first], ends[first], JOIN_UNITS):
                part = text.take(pa.array(codes[at:min(at + JOIN_UNITS, ends[first])]))
                state.update((b";" if at > starts[first] else b"") + pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), ";")[0].as_buffer())
            out.append(state.hexdigest())
        first = last
    return out


def align_chunk(al: Aligner, doc_ids: pa.Array, texts: pa.Array) -> tuple:
    """Columns of one chunk, without its number.  ``codes``: units of each document in turn, as numbers
    among the distinct units of the chunk; ``unit_pairs``: their links, as numbers in ``pairs``."""
    flat, ends = cut_pieces(texts, False, True) if al.cut else (pa.array([marked(t) for t in texts.to_pylist()], pa.string()), np.arange(1, len(texts) + 1))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    text, sizes, all_links = al.values(coded.dictionary)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    per_doc = np.stack([_runs(sizes[codes, k], ends - starts) for k in range(5)], axis=1)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    whole = (per_doc[:, 4] == ends - starts) & ~empty
    per_doc[~whole] = 0
    shas = [h if ok else "" for h, ok in zip(group_hashes(text, codes, ends), whole.tolist())]
    keep = np.repeat(whole, ends - starts)
    docs = pa.StructArray.from_arrays([doc_ids.cast(pa.int64()), *[pa.array(per_doc[:, k]) for k in range(4)],
                                       pa.array(shas, pa.string()), pa.array(((ends - starts) * whole).astype(np.int32))], fields=list(DOC))
    used = np.bincount(codes[keep], minlength=len(sizes))
    pairs, place = np.unique(all_links, return_inverse=True)
    counts = np.bincount(place, weights=np.repeat(used, sizes[:, 3]), minlength=len(pairs)).astype(np.int64)
    return (docs, codes[keep].astype("<i4").tobytes(), place.astype("<i4").tobytes(), sizes[:, 3].astype("<i4").tobytes(), pairs, counts)


def chunks(df: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of documents, as they lie in the table."""

    def row(number: int, al: Aligner, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        docs, codes, unit_pairs, unit_sizes, pairs, counts = align_chunk(al, ids, texts)
        one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(docs), pa.array([codes], pa.binary()), pa.array([unit_pairs], pa.binary()),
             pa.array([unit_sizes], pa.binary()), one(pa.array(pairs)), one(pa.array(counts))],
            names=["chunk", "docs", "codes", "unit_pairs", "unit_sizes", "pairs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in byte_slices(batch.column(1).cast(pa.string()), chunk_bytes):
                yield row(number, al, batch.column(0).slice(first, len(texts)), texts)
                number += 1

    # one chunk a row group: neither the writer nor a reader holds more than one, however many a task makes
    return common.write_shared(common.texts(df).mapInArrow(run, CHUNK_SCHEMA), "align-chunks", **{"parquet.block.row.count.limit": 1})


def pair_counts(written: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no other pair of
    its B id has more."""
    met = written.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    summed = common.write_shared(met.filter("counts > 0").groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
                                 .withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "align-pairs")
    highest = summed.groupBy("b").agg(F.max("n").alias("most"))
    return summed.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    written = chunks(df, path_a, path_b, chunk_bytes)
    asked = written.select("chunk", F.explode("pairs").alias("pair"))
    known = asked.join(pair_counts(written), "pair").select(F.col("chunk").alias("of"), "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs)
        value = np.stack([right.column("n").to_numpy(), right.column("best").to_numpy().astype(np.int64)], axis=1)[order]
        out = [EMPTY]
        for i in range(left.num_rows):  # one row: a chunk
            docs, own = (left.column(c).combine_chunks().slice(i, 1).flatten() for c in ("docs", "pairs"))
            codes, place, sizes = (np.frombuffer(left.column(c)[i].as_py(), "<i4") for c in ("codes", "unit_pairs", "unit_sizes"))
            own = own.to_numpy()
            known = np.isin(own, pairs)
            sums = []
            for k in range(2):
                met = np.zeros(len(own), np.int64)  # pairs that no document with tokens holds stay 0
                met[known] = value[np.searchsorted(pairs[order], own[known]), k]
                sums.append(_runs(_runs(met[place], sizes)[codes], docs.field("size").to_numpy()))
            out.append(pa.Table.from_arrays([docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                                            + [pa.array(sums[1]), pa.array(sums[0]), docs.field("sha")], schema=EMPTY.schema))
        return pa.concat_tables(out)

    body = written.select("chunk", "docs", "codes", "unit_pairs", "unit_sizes", "pairs")
    return body.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of numbers, of the given sizes."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes, dtype=np.int64)
    return total[ends] - total[ends - sizes]


EMPTY = pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in (
    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})


def op13_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """All documents, byte-level vocabulary against the one with byte fallback (one row per document)."""
    import public_tokenizers

    return align(common.documents(spark, sf_dir), path_a or public_tokenizers.path("byte_bpe_50k.json"),
                 path_b or public_tokenizers.path("piece_bpe_32k.model"))
