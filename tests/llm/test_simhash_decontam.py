import hashlib
import pickle
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from authornet.llm import common, decontam, simhash
from authornet.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_simhash_equals_brute_force(results, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    classes = brute_classes(fps)
    for r in results("op2_simhash"):
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == classes[r["doc_id"]]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_anchors_cover_three_bits(u, flips):
    v = u
    for b in flips:
        v ^= 1 << b
    _, a, home = simhash.anchors(np.array([u], dtype=np.uint64))
    _, b, _ = simhash.anchors(np.array([v], dtype=np.uint64))
    assert set(a[home]) & set(b)


@pytest.mark.parametrize("block", [2, 4096])
def test_links_hold_dense_groups_together(spark, block):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 2**63, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(distinct, block=block).collect()
    assert all((e["a"] % 2**64 ^ e["b"] % 2**64).bit_count() <= 3 for e in edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = brute_classes({x: x % 2**64 for x in signed})
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_keep_first_keeps_one_of_each_class(spark, results):
    kept = [r["doc_id"] for r in simhash.keep_first(common.documents(spark, SF)).select("doc_id").collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in results("op2_simhash")})


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for k, t in items:
        w = low(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i:i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(k)
    return len(words), hit, found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), max_size=4), st.text("abc", max_size=40), st.integers(1, 4))
def test_automaton_equals_brute_force(items, text, window):
    items = [(str(k), " ".join(t)) for k, t in enumerate(items)]
    text = " ".join(text)
    auto = decontam.Automaton(items, window)
    spans, found = auto.scan(decontam.words_of(text))
    _, hit, names = brute_hits(text, items, window)
    assert {i for s, e in spans for i in range(s, e)} == hit
    assert {auto.names[k] for k in found} == names
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_decontam_parts_agree(spark, results):
    """Several automata passes over the rows unite to what one finds."""
    docs = common.documents(spark, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    parts = {r["doc_id"]: r for r in decontam.find_hits(docs, bench, part_bytes=4000).collect()}
    assert len(parts) == 200
    for r in results("op8_decontam"):
        p = parts[r["doc_id"]]
        assert (p["n_words"], p["n_hit"]) == (r["n_words"], r["n_hit"])
        assert hashlib.sha256(",".join(sorted(p["items"])).encode()).hexdigest() == r["items_sha256"]
    kept = [{x["doc_id"]: x["text"] for x in decontam.decontaminate(docs, bench, part_bytes=n).collect()} for n in (4000, 1 << 20)]
    assert kept[0] == kept[1]
    bad = {r["doc_id"] for r in results("op8_decontam") if r["contaminated"]}
    assert set(kept[0]) == {r["doc_id"] for r in results("op8_decontam")} - bad


def test_spans_are_cut_and_nothing_else():
    text = "Keep this. One, two THREE four! Keep that."
    auto = decontam.Automaton([("1", "one two three four")], 4)
    spans, _ = auto.scan(decontam.words_of(text))
    assert decontam.cut_words(text, spans) == "Keep this. ! Keep that."


def test_parts_are_built_in_tasks(spark):
    """Several automata come one after the other, and together hold all items."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    size = sum(len(r["text"].encode()) for r in bench.collect())
    whole = decontam.automata(bench)
    assert whole[0] == 1
    n, autos = decontam.automata(bench, part_bytes=-(-size // 3))
    assert n == 3 and iter(autos) is autos
    names = [sorted(pickle.loads(a).names) for a in autos]
    assert all(names) and sorted(sum(names, [])) == sorted(pickle.loads(next(whole[1])).names)
