import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from authornet.llm import token_files
from authornet.llm.packing import best_fill, plan_windows
from authornet.llm.tokens import BulkEncoder

FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))
ALPHABET = st.sampled_from(list(" \n\t.,!'a bcdZ9éßİ日́_-\x1c\x02\x03") + ["'s ", ". ", ", ", ".\n", "foo", " bar", "\u0958", "e\u0301", "\u212b", "ΑΣ", "Σ", "ǅ", "THE"])


@pytest.fixture(scope="module")
def pairs():
    return [(BulkEncoder(public_tokenizers.path(f), spaced), Tokenizer.from_file(public_tokenizers.path(f))) for f, spaced in FILES]


@settings(max_examples=800, deadline=None)
@given(parts=st.lists(ALPHABET, max_size=30))
def test_bulk_ids_equal_the_tokenizers(pairs, parts):
    text = "".join(parts)
    for bulk, plain in pairs:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bulk.encode([text])[0], "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=9), st.integers(1, 20))
def test_best_fill_is_optimal(counts, room):
    counts = np.array([0, *counts])
    total, chosen = best_fill(counts, room)
    reach = {0}
    for length, n in enumerate(counts.tolist()):
        for _ in range(n):
            reach |= {s + length for s in reach if s + length <= room}
    assert total == max(reach) == sum(k * v for k, v in chosen.items())
    assert all(v <= counts[k] for k, v in chosen.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=16, max_size=16))
def test_plan_places_every_remainder_once(counts):
    counts = np.array(counts)
    segments, windows = plan_windows(counts, 16)
    for length in range(1, 16):
        ranks = sorted(r for s in segments if s[0] == length for r in range(s[1], s[2]))
        assert ranks == list(range(counts[length]))
    tokens = int((np.arange(16) * counts).sum())
    assert windows == -(-tokens // 16)  # only the last window is short


def check_packing(rows, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"]:at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    short = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        short += at < 2048
    assert short <= 1


def test_packing_round_trip(results, texts):
    check_packing(results("op1_packing"), texts)


def test_segments_round_trip_and_random_access():
    ids = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7] * 300, dtype=np.uint32)
    lengths = np.array([5, 0, len(ids) - 5])
    seg = token_files.Segment(token_files.encode_segment([3, None, 9], lengths, ids))
    assert (seg.all() == ids).all() and len(seg.levels) == 4
    assert [seg.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    assert seg.known.tolist() == [1, 0, 1] and seg.starts.tolist() == [0, 5, 5, len(ids)]


def test_token_files_equal_the_tokenizer(results, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, at = {r["doc_id"]: r for r in results("op6_token_files")}, 0
    for d in sorted(texts):
        ids = np.array(plain.encode(texts[d], add_special_tokens=False).ids + [0], dtype="<u4")
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_tokens_at_reads_single_tokens(spark):
    from authornet.llm import common

    files = token_files.write_tokens(common.documents(spark, "/root/testdata/sf0.001"), public_tokenizers.path("byte_bpe_50k.json"),
                                     segment_ids=5000)
    first = files.orderBy("part", "nth").first()
    seg = token_files.Segment(bytes(first["payload"]))
    wanted = spark.createDataFrame([(first["part"], first["nth"], i) for i in (0, 17, 4000)], "part int, nth int, i bigint")
    got = {r["i"]: r["token"] for r in token_files.tokens_at(files, wanted).collect()}
    assert got == {i: int(seg.all()[i]) for i in (0, 17, 4000)}
