"""Page extraction, Merkle manifest and token alignment against brute force and by hand."""
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from authornet.llm import alignment, html_text, merkle

from .conftest import SF


# --- pages -------------------------------------------------------------------------------------

@pytest.mark.parametrize("page, kept", [
    ("<p>a<b>b</b>c &amp; d</p>", ["abc & d"]),
    ("<div><nav>menu</nav><p>one<p class='ad'>buy<p>two</div><form>mail</form>", ["one", "two"]),
    ("<article><header><h1>T</h1></header><p>x<aside>s</aside><section class='comments'><p>c</p></section></article><footer>f", ["T", "x"]),
    ("<form><article>inside</article></form><div>outside</div>", ["inside"]),
    ("<main><p>m</p></main><p>other</p>", ["m"]),
    ("<script>if (a < b) { '</p>' }</script>z<style>p > q {}</style>", ["z"]),
    ('<p title="a>b">q</p>', ["q"]), ('<p title="open>q</p>', ["q"]),
    ("3 < 5 and 6 > 4", ["3 < 5 and 6 > 4"]),
    ("a <!-- c > d --> b <!-- never closed", ["a b"]),
    ("<span class='advert'>no</span>yes", ["yes"]), ("<div style='display: none'>no</div>yes", ["yes"]),
    ("&lt;p&gt; &copy; &#x41;&#66; &nbsp;x", ["<p> © AB x"]),
    ("<ul><li>1<li class=ad>2<li>3</ul>", ["1", "3"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
    ("", []), ("<", ["<"]), ("<p", []), ("</p></div>x", ["x"]),
])
def test_blocks_by_role(page, kept):
    assert html_text.roles(page)[1] == kept


def test_roles_need_linear_time():
    import time
    took = []
    for n in (20_000, 80_000):
        page = "<div><b>" * n + "</i></p>" * n + '<a title="' * n + "x"
        t0 = time.perf_counter()
        html_text.roles(page)
        took.append(time.perf_counter() - t0)
    assert took[1] < 12 * took[0] + 0.5


def test_given_pages_keep_their_article_whole(spark, ):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.op11_html(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def brute_unique(pages, length, min_pages):
    """Text of undeclared pages without strings of ``length`` tokens on ``min_pages`` pages of their host."""
    parts = {}
    for k, (url, page) in enumerate(pages):
        declared, kept, others = html_text.roles(page or "")
        stream = " ".join(others if declared else kept + others).split(" ")
        windows = {tuple(stream[i:i + length]) for i in range(len(stream) - length + 1)}
        parts[k] = (html_text.HOST.match(url or "")[1] if url else "", declared, kept, windows, "\n".join(kept + others))
    seen = {}
    for host, _, _, windows, content in parts.values():
        for w in windows:
            seen.setdefault((host, w), set()).add(content)
    out = {}
    for k, (host, declared, kept, _, _) in parts.items():
        words = " ".join(kept).split(" ")
        gone = set()
        if not declared:
            for i in range(len(words) - length + 1):
                if len(seen.get((host, tuple(words[i:i + length])), ())) >= min_pages:
                    gone |= set(range(i, i + length))
        out[k] = " ".join(w for i, w in enumerate(words) if i not in gone)
    return out


def test_open_pages_lose_strings_that_their_host_repeats(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(3000))
    frames = [" ".join(word() for _ in range(n)) for n in (6, 9, 14, 30)]
    pages = []
    for k in range(60):
        host = "https://a.example" if k % 3 else "http://b.example"
        body = "".join(f"<p>{' '.join(word() for _ in range(rng.randrange(3, 40)))}</p>" for _ in range(3))
        frame = f"<div>{frames[k % 4]}</div>"
        pages.append((f"{host}/{k}", rng.choice([frame + body, body + frame, f"<nav>{frames[3]}</nav>" + body,
                                                 f"<article>{body}</article>{frame}"])))
    pages += [pages[1], pages[1], (None, None), (None, "<p>" + frames[3] + "</p>"), ("https://a.example/x", "")]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    df = df.withColumn("row", F.lit("x")).withColumn("keys", F.lit("x")).withColumn("text", F.lit("x"))
    for least in (2, 3):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df, min_pages=least).collect()}
        assert got == brute_unique(pages, html_text.LENGTH, least)
    assert any(frames[2] not in got[k] and frames[2] in (h or "") for k, (_, h) in enumerate(pages))
    assert html_text.extract(df.limit(0)).count() == 0


def test_declared_articles_go_through_the_suffixes_as_well(spark):
    """A string that the host repeats is found inside declared articles too; the exact check puts it back there."""
    frame = " ".join(f"f{k}" for k in range(9))
    pages = [(k, f"https://a.example/{k}", f"<p>{frame}</p><p>own{k}</p>") for k in range(3)]
    pages += [(10, "https://a.example/10", f"<article><p>start {frame} end</p></article>"), (11, "https://b.example/", f"<article>{frame}</article>"),
              (12, "https://a.example/12", "<article></article>"), (13, None, None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_text.extract(df).collect()}
    assert got == {0: ("own0", 9), 1: ("own1", 9), 2: ("own2", 9), 10: (f"start {frame} end", 9), 11: (frame, 0), 12: ("", 0), 13: ("", 0)}


def test_filter_rules_out_no_repeated_key(spark):
    import numpy as np
    keys = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 4000)
    bits = html_text.key_filter(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key bigint"))
    assert html_text.may_be_in(keys[:2000], bits).all() and html_text.may_be_in(keys[2000:], bits).mean() < 0.05
    assert not html_text.may_be_in(keys, html_text.key_filter(spark.createDataFrame([], "key bigint"))).any()


# --- manifest ----------------------------------------------------------------------------------

def brute_manifest(groups, fanout):
    """{(group, position): (leaf, subroot, root, proof, folded)} by plain recursion."""
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([merkle.digest("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // fanout * fanout:][:fanout]
            out.append((run[:at % fanout], run[at % fanout + 1:]))
            at //= fanout
        return out

    trees = {g: climb([leaf for leaf, _ in rows]) for g, rows in groups}
    top = climb([trees[g][-1][0] for g, _ in groups])
    result = {}
    for nth, (g, rows) in enumerate(groups):
        for at, (leaf, changed) in enumerate(rows):
            way = path(trees[g], at) + path(top, nth)
            proof, node = "", changed
            for left, right in way:
                proof += "".join(left + right)
                node = merkle.digest("".join(left) + node + "".join(right))
            result[g, at] = (leaf, trees[g][-1][0], top[-1][0], merkle.digest(proof), node, node == top[-1][0])
    return result


@pytest.mark.parametrize("fanout, height", [(2, 2), (2, 0), (3, 1), (2, 12), (4, 1)])
def test_manifest_equals_plain_recursion(spark, fanout, height):
    rng = random.Random(fanout * 10 + height)
    sizes = {None: 1, "": 2, "de": 37, "en": 70, "zz": 5, "é": 9}
    groups, rows = [], []
    for g in sorted(sizes, key=lambda x: (x is not None, (x or "").encode())):
        leaves = [merkle.digest(f"{g}{i}") for i in range(sizes[g])]
        changed = [merkle.digest(x) if rng.random() < 0.2 else x for x in leaves]
        groups.append((g, list(zip(leaves, changed))))
        rows += [(i, g, a, b) for i, (a, b) in enumerate(zip(leaves, changed))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key bigint, tree string, node string, changed string").repartition(5)
    got = {(r["key"], r["leaf"]): tuple(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
           for r in merkle.manifest(df, fanout=fanout, height=height).collect()}
    want = brute_manifest(groups, fanout)
    assert got == {(at, v[0]): v for (g, at), v in want.items()}


def test_documents_have_the_leaves_of_the_contract(spark, results):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = results("op12_merkle")
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r["doc_id"]]
        text = "".join("-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in merkle.FIELDS)
        assert r["leaf"] == merkle.digest(text)
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


# --- alignment ---------------------------------------------------------------------------------

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def al():
    return alignment.Aligner(*PATHS)


def brute_align(al, text):
    """(groups, links as id pairs) by walking both token lists byte by byte; None without tokens."""
    both = al._stream(text) if text else None
    if both is None:
        return None
    owners = []
    for ids, size in zip(both, (al.len_a, al.len_b)):
        owners.append([k for k, i in enumerate(ids.tolist()) for _ in range(size[i])])
    seen = list(dict.fromkeys(zip(*owners)))
    a, b = (x.tolist() for x in both)
    groups, a0, b0 = [], 0, 0
    for byte in range(1, len(owners[0]) + 1):
        ends = [byte == len(o) or o[byte] != o[byte - 1] for o in owners]
        if all(ends):
            a1, b1 = owners[0][byte - 1] + 1, owners[1][byte - 1] + 1
            groups.append((a[a0:a1], b[b0:b1]))
            a0, b0 = a1, b1
    return groups, [(a[i], b[j]) for i, j in seen]


def brute_corpus(al, texts):
    parts = [brute_align(al, t) for t in texts]
    count = Counter(p for x in parts if x for p in x[1])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for x in parts:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, pairs = x
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(pairs),
                    sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = ["", "a", "a  b c", "  lead", "trail ", "x\n\ny z", "x\ny", "\nq", "q\n", " \n ", "tab\tx y", "▁ x", "foo▁bar baz", "<|endoftext|> <s> hi",
       "日本語 テキスト 日本語", "é x", "nbsp\xa0x y", "it's 's 'll don't", "a\x00b c", "\x02 z", "\x03 z \x02", "ﬁ ① Ａ", "😀 😀😀 x",
       "<0x41> x", "a" * 300 + " b", "x \ny", "x\n y", "\r\n);\r\n a", " x y", "word.\nNext, (paren) \"quote\" 12345 1 2", " em　 x"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, al):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["x\ny", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("chunk", F.lit("x")).repartition(3)
    want = brute_corpus(al, [t or "" for t in texts])
    for chunk_bytes in (alignment.CHUNK_BYTES, 700):
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, *PATHS, chunk_bytes=chunk_bytes).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_a_row_group_holds_one_chunk(spark):
    """A task's chunks are neither written nor read together, however many it has."""
    import pyarrow.parquet as pq
    df = spark.createDataFrame([(i, f"one more text {i} " * 20) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    written = alignment.chunks(df, *PATHS, chunk_bytes=700)
    groups = [pq.read_metadata(f.removeprefix("file://")) for f in written.inputFiles()]
    assert sum(g.num_row_groups for g in groups) == written.count() > 10


def test_units_met_before_and_new_ones_keep_their_rows(al, monkeypatch):
    monkeypatch.setattr(alignment, "STREAM_UNITS", 3)
    texts = pa.array(["ab cd ef gh ij", "cd new ab\x02 ef kl mn op", "", "  x\ny z", "kl ab new"], pa.string())
    al._forget()
    for part in (texts.slice(0, 2), texts, texts.slice(1)):  # some units known, all known
        got = [(d["n_groups"], d["n_links"], d["sha"]) for d in alignment.align_chunk(al, pa.array(range(len(part)), pa.int64()), part)[0].to_pylist()]
        for g, t in zip(got, part.to_pylist()):
            want = brute_align(al, t)
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[0]) if want else ""
            assert g == ((len(want[0]), len(want[1]), hashlib.sha256(text.encode()).hexdigest()) if want else (0, 0, ""))


def test_hashes_of_long_documents_are_joined_in_pieces(monkeypatch):
    text, codes, ends = pa.array(["1|2", "3,4|5", "6|7"]), np.array([0, 1, 2, 2, 1, 0, 1, 0], dtype=np.int32), np.array([3, 3, 7, 8])
    want = alignment.group_hashes(text, codes, ends)
    assert want[0] == hashlib.sha256(b"1|2;3,4|5;6|7").hexdigest()
    for n in (1, 2, 3):
        monkeypatch.setattr(alignment, "JOIN_UNITS", n)
        assert alignment.group_hashes(text, codes, ends) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t ▁.,'0　\x02日", max_size=30), min_size=1, max_size=4))
def test_units_stand_alone(al, texts):
    docs, *_ = alignment.align_chunk(al, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()))
    for d, t in zip(docs.to_pylist(), texts):
        want = brute_align(al, t)
        assert (d["n_groups"], d["n_links"]) == ((len(want[0]), len(want[1])) if want else (0, 0))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40))
def test_divide_and_conquer_finds_every_shared_end(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    want = [(a.index(e) + 1, b.index(e) + 1) for e in a if e in b]
    assert [tuple(g) for g in alignment.split_groups(np.array(a), np.array(b)).tolist()] == want
    i, j = alignment.links(np.array(a), np.array(b))
    spans = [(s, e) for s, e in zip([0] + a, a)], [(s, e) for s, e in zip([0] + b, b)]
    brute = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (u, v) in enumerate(spans[1]) if s < v and u < e]
    assert list(zip(i.tolist(), j.tolist())) == brute
