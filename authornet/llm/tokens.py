"""Token ids of whole texts by a public tokenizer file, in bulk.

Both vocabularies used here cut a text before any merge wherever a single space stands between two other characters, so
the ids of a text are the ids of its pieces in order.  Texts are cut and their pieces numbered by Arrow kernels; only the
distinct pieces of a batch meet Python, which looks them up in a table of pieces met before; and the ids are gathered by piece
number.  Pieces that are missing from the table go through the tokenizer many in a call, whose output is cut apart at the
vocabulary's own word marks.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 800_000
# What stays when the table is full: short pieces, which are the frequent ones.
KEPT_LENGTH = 9
LONG_PIECE = 80
CALL_WORDS = 500
# Bytes of text whose pieces are numbered together.
SLICE_BYTES = 4 << 20
TAIL = ".,!&%#*$|;:?)"
# Letters whose lower case is one letter that composes with nothing around it; no marks of pieces among them.
LATIN = r"^[\x20-\x{12f}\x{131}-\x{24f}]*$"

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# White space that is not one space or line end between other characters; the marks below.
UNEVEN = rf"{SPACE}{SPACE}|^{SPACE}|{SPACE}$|[\x02\x03\x04\t\x0b-\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
CUT = re.compile(r"(?<=\S) (?=\S)")
# First character of a piece: it follows a line end instead of a space; it begins with one of the marks itself; it
# opens its text.
LINE_END, PLAIN, FIRST = "\x02", "\x03", "\x04"
MARKS = (LINE_END, PLAIN, FIRST)


def per_worker(key: tuple, make):
    """One object per Python worker process, kept from task to task."""
    store = sys.modules.setdefault("authornet_worker_state", types.ModuleType("authornet_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + size, side="right")))
        yield first, pa.concat_arrays([texts.slice(first, last - first)])
        pa.default_memory_pool().release_unused()  # the pool would keep what the largest slice needed
        first = last


def marked(text: str) -> str:
    return PLAIN + text if text.startswith(MARKS) else text


def cut_pieces(texts: pa.Array, first: bool, line_ends: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts one after the other, their ends per text); pieces stand without the space before them.
    ``first``: opening pieces are marked; ``line_ends``: pieces after a line end are marked, else a line end is a space."""
    uneven = pc.match_substring_regex(texts, UNEVEN)
    even = pc.replace_substring(pc.if_else(uneven, "", texts), "\n", f" {LINE_END}" if line_ends else " ")
    if first:
        even = pc.binary_join_element_wise(FIRST, even, "")
    rows = pc.split_pattern(even, " ")
    flat, ends = rows.flatten(), rows.offsets.to_numpy()[1:].astype(np.int64) - rows.offsets[0].as_py()
    odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
    if not len(odd):
        return flat, ends
    parts, counts, last = [], np.diff(ends, prepend=0), 0
    for i in odd.tolist():  # an uneven text has one empty piece so far; its own pieces take that place
        head, *rest = CUT.split(texts[i].as_py())
        own = [FIRST + head if first else marked(head), *map(marked, rest)]
        parts += [flat.slice(last, ends[i] - 1 - last), pa.array(own, flat.type)]
        counts[i], last = len(own), ends[i]
    parts.append(flat.slice(last))
    return pa.concat_arrays(parts), np.cumsum(counts)


class BulkEncoder:
    """``path``: a tokenizers JSON file.  ``spaced``: True where a piece's leading
    space belongs to its first token (byte-level), False where white space is dropped.
    Pieces met before are two columns: the piece, and its ids as little-endian bytes."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced = spaced
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.mark = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, i in vocab.items():
            self.mark[i] = piece.startswith("Ġ") if spaced else piece.endswith("</w>")
        self.newline = np.zeros_like(self.mark)
        self.newline[vocab.get("Ċ", 0)] = True
        self.glue = " " if spaced else ""
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _letters(self, words: pa.Array, glue: str, mark: np.ndarray, starts: bool) -> pa.Array:
        """Ids of words of letters only, many words in a call; ``mark`` tells the
        tokens that open (``starts``) or close a word."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        words = words.to_pylist()
        for at in range(0, len(words), CALL_WORDS):
            part = words[at:at + CALL_WORDS]
            ids = self._ids((glue or " ").join(["", *part] if glue else part))
            marks = np.flatnonzero(mark[ids])
            if len(marks) == len(part):
                flat.append(ids)
                sizes.append(np.diff(marks, append=len(ids)) if starts else np.diff(marks, prepend=-1))
            else:  # a letter that normalises into something else
                single = [self._ids(glue + w) for w in part]
                flat += single
                sizes.append(np.array([len(x) for x in single]))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * 4
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(np.concatenate(flat).tobytes())])

    def _learn(self, pieces: pa.Array, core: pa.Array, cores: pa.Array, at: pa.Array) -> pa.Array:
        """Ids of distinct pieces that are not in the table.  ``core``: each piece without signs at its end;
        ``cores``: distinct ones that are words, with their rows ``at`` in the table (null: not there)."""
        word = pc.utf8_is_alpha(pieces)
        split = pc.and_(pc.invert(word), pc.is_in(core, value_set=cores))
        words = pc.unique(pa.concat_arrays([pieces.filter(word), cores.filter(pc.is_null(at)), core.filter(split)]))
        words = words.filter(pc.is_null(pc.index_in(words, value_set=cores.filter(pc.is_valid(at)))))
        keys, ids = [words], [self._letters(words, self.glue, self.mark, self.spaced)]
        line = pc.and_(pc.starts_with(pieces, LINE_END), pc.utf8_is_alpha(pc.utf8_slice_codeunits(pieces, 1)))
        if self.spaced and pc.any(line).as_py():
            keys.append(pieces.filter(line))
            ids.append(self._letters(pc.utf8_slice_codeunits(keys[-1], 1), "\n", self.newline, True))
        # a letter before a sign always ends a word: ids of the word, then those of the signs
        own, cut = pieces.filter(split).to_pylist(), core.filter(split)
        tails = [p[len(c):] for p, c in zip(own, cut.to_pylist())]
        tail_ids = {t: self._whole(t) for t in set(tails)}
        old = cores.filter(pc.is_valid(at))
        heads = pa.concat_arrays([self.ids.take(at.drop_null()), ids[0]]).take(pc.index_in(cut, value_set=pa.concat_arrays([old, words])))
        keys.append(pieces.filter(split))
        ids.append(pc.binary_join_element_wise(heads, pa.array([tail_ids[t] for t in tails], pa.binary()), b""))
        place = pc.index_in(pieces, value_set=pa.concat_arrays(keys))
        absent = pc.is_null(place)
        rest = pieces.filter(absent).to_pylist()
        ids.append(pa.array([self._whole(self.glue + p if not p.startswith(MARKS) else p[1:] if p[0] == FIRST else
                                         ("\n" if p[0] == LINE_END else self.glue) + p[1:]) for p in rest], pa.binary()))
        row = place.fill_null(0).to_numpy().copy()
        row[absent.to_numpy(zero_copy_only=False)] = sum(map(len, keys)) + np.arange(len(rest))
        return pa.concat_arrays(ids).take(pa.array(row))

    def _lower(self, piece: str) -> str:
        """The vocabulary without spaces lower-cases letter by letter after composing them; doing so first halves the
        forms of a word.  Where the order or the neighbours matter, it is left to it."""
        if piece.startswith(MARKS):
            return piece
        low = piece.lower()
        if "İ" not in piece and "Σ" not in piece and unicodedata.is_normalized("NFC", piece) and unicodedata.is_normalized("NFC", low):
            return low
        return PLAIN + piece

    def _keys(self, pieces: pa.Array) -> pa.Array:
        if self.spaced:
            return pieces
        plain = pc.match_substring_regex(pieces, LATIN)
        odd = pc.invert(plain)
        low = pc.utf8_lower(pieces)
        return pc.replace_with_mask(low, odd, pa.array([self._lower(p) for p in pieces.filter(odd).to_pylist()], pa.string())) if pc.any(odd).as_py() else low

    def _values(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces; short pieces are kept for later batches."""
        if len(self.keys) > CACHE_PIECES:
            kept = pc.less_equal(pc.utf8_length(self.keys), KEPT_LENGTH)
            if pc.sum(kept).as_py() > CACHE_PIECES // 2:
                kept = pa.array(np.zeros(len(self.keys), dtype=bool))
            self.keys, self.ids = self.keys.filter(kept), self.ids.filter(kept)
        keys = self._keys(pieces)
        new = pc.unique(keys)
        core = pc.utf8_rtrim(new, TAIL)
        cores = pc.unique(core.filter(pc.and_(pc.not_equal(core, new), pc.utf8_is_alpha(core))))
        # one look into the table for pieces and their cores
        at = pc.index_in(pa.concat_arrays([keys, cores]), value_set=self.keys)
        at, cores_at = at.slice(0, len(keys)), at.slice(len(keys))
        absent = pc.is_null(at)
        if not pc.any(absent).as_py():
            return self.ids.take(at)
        missing = pc.is_in(new, value_set=keys.filter(absent))
        new, core = new.filter(missing), core.filter(missing)
        ids = self._learn(new, core, cores, cores_at)
        place = at.fill_null(0).to_numpy().copy()
        place[absent.to_numpy(zero_copy_only=False)] = len(self.keys) + pc.index_in(keys.filter(absent), value_set=new).to_numpy()
        out = pa.concat_arrays([self.ids, ids]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(new), LONG_PIECE)
        self.keys, self.ids = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their ends per text), of about SLICE_BYTES of text."""
        flat, ends = cut_pieces(texts, self.spaced, self.spaced)
        coded = flat.dictionary_encode()
        rows = self._values(coded.dictionary).take(coded.indices)
        _, offsets, data = rows.buffers()
        stops = np.frombuffer(offsets, "<i4", len(rows) + 1, 4 * rows.offset)
        ids = np.frombuffer(data, "<u4")[stops[0] // 4:stops[-1] // 4] if data is not None else np.zeros(0, "<u4")
        return ids, (stops[ends] - stops[0]).astype(np.int64) // 4

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode_flat` with ``end_id`` behind every text."""
        ids, ends = self.encode_flat(texts)
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for _, part in byte_slices(pa.array(batch, pa.string())):
            ids, ends = self.encode_flat(part)
            raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            out += [raw[s:e] for s, e in zip([0, *ends], ends)]
        return out


def encoder(path: str, spaced: bool) -> BulkEncoder:
    return per_worker(("encoder", path, spaced), lambda: BulkEncoder(path, spaced))
