"""Main text of web pages: markup roles and a suffix array per host.

A page is read once into blocks.  Their markup tells three roles: *chrome* (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts), *article* (inside the element by which the page declares its article) and *open*.

Method: the token streams of a host's pages are one text, and the suffixes of that text, sorted to a depth of ``LENGTH``
tokens, show every string of that length which begins more than one suffix.  The suffixes lie in Spark as
(host, 64-bit hash of the first ``LENGTH`` tokens), so the groups of equal keys are the intervals of the suffix array
whose common prefix is long enough.  Strings found on ``MIN_PAGES`` pages of different content are boilerplate.  Every
page, whether it declares its article or not, looks up all suffixes of its kept text, and the tokens that boilerplate
covers are marked; unique runs stay.  The streams hold all text outside declared articles, from every page of the host.

Exact check, after that step: a marked run goes from the text of a page that declares nothing and goes back into a declared
article, which keeps exactly that element's text (without chrome inside it), since mirrored pages and quoted passages
repeat whole articles; chrome is removed even where it is unique.  ``n_repeated`` counts the marked tokens of either.

Edge cases: null and empty html give an empty text; null urls share the host ''; repeated rows are pages of equal content and
count as one; an unclosed element ends with its page; an empty table gives an empty result; extra columns are ignored;
pages of any length are read in linear time.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Depth of the suffix order, in tokens, and how many pages make a string boilerplate.
LENGTH = 8
MIN_PAGES = 3
# Size of the filter through which pages look up their suffixes, at most (32 MB); beyond it more of them reach the join.
FILTER_BITS = 1 << 28

# Fixed values of the HTML language: elements without content, elements whose content is no markup,
# elements inside a line, elements that end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
             "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# An element that is opened again closes the last one of the group, up to the given container.
REOPENED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
            "option": ({"option"}, {"select", "datalist"})}
# Roles: elements, ARIA roles and words of class or id that mark chrome; words that mark it only outside an article.
CHROME_TAGS = set("head nav footer aside form script style noscript template button select textarea input option datalist iframe "
                  "object svg canvas audio video dialog menu search noframes noembed xmp title".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_WORDS = set("ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies "
                   "consent gdpr promo promotion sponsor sponsored sidebar newsletter subscribe subscription popup modal overlay "
                   "notice alert share sharing social related recommended recommendations comment comments commentlist disqus "
                   "respond replies widget pagination pager login signup paywall".split())
OUTER_WORDS = set("nav navbar navigation menu header masthead footer toolbar topbar search".split())
ARTICLE_CLASSES = set("article-body articlebody article-content post-content post-body entry-content story-body".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

MARKUP = re.compile(r"""<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""", re.X)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*+"?|'[^']*+'?|[^\s"'=<>`]+))?""")
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ARTICLE, MAIN, NAMED = 3, 2, 1  # how a page declares its article, strongest first
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")


class Element:
    __slots__ = ("name", "chrome", "level")

    def __init__(self, name: str, chrome: int, level: int):
        self.name, self.chrome, self.level = name, chrome, level


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)} if rest.strip("/ \n\t") else {}


def _open(name: str, rest: str, parent: Element) -> Element:
    """Role of an element: chrome 2 is certain, 1 a form, which an article inside it overrules."""
    attrs = _attributes(rest)
    chrome, level = parent.chrome, parent.level
    words = set(WORD.findall(CAMEL.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())) if attrs else set()
    if name in ("article", "main") or attrs.get("role") == "main":
        if chrome < 2 and not words & {"comment", "comments", "ad", "ads", "teaser", "related"}:
            return Element(name, 0, max(level, ARTICLE if name == "article" else MAIN))
        return Element(name, 2, level)
    if name in CHROME_TAGS:
        chrome = max(chrome, 1 if name == "form" else 2)
    elif name == "header" and not level:
        chrome = 2
    if attrs and name not in ("html", "body"):
        style = attrs.get("style", "").replace(" ", "").lower()
        if attrs.get("role", "").lower() in CHROME_ROLES or "hidden" in attrs or "display:none" in style:
            chrome = 2
        elif words & CHROME_WORDS or (not level and name not in HEADINGS and words & OUTER_WORDS):
            chrome = 2
        elif attrs.get("itemprop") == "articleBody" or set(attrs.get("class", "").lower().split()) & ARTICLE_CLASSES:
            level = max(level, NAMED)
    return Element(name, chrome, level)


def blocks(page: str) -> list[tuple[int, int, str]]:
    """(chrome, level, text) of a page's blocks in order; white space is single, empty blocks are left out."""
    stack, counts = [Element("", 0, 0)], Counter()
    out: list[tuple[int, int, str]] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = "".join(line)
            line.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((stack[-1].chrome, stack[-1].level, text))

    def pop_to(names: set[str], stop: set[str]) -> None:
        """Close the innermost element of ``names`` unless one of ``stop`` is inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in stop:
                return
            if stack[i].name in names:
                for e in stack[i:]:
                    counts[e.name] -= 1
                del stack[i:]
                return

    at = 0
    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            line.append(page[at:])
            break
        if m.start() > at:
            line.append(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, rest = name.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if closing:
            if counts[name] > 0:
                if name not in INLINE or any((e.chrome, e.level) != (stack[-1].chrome, stack[-1].level) for e in stack[-2:]):
                    flush()
                pop_to({name}, set())
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            flush()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        if name in ENDS_P and counts["p"] > 0:
            pop_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if name in REOPENED and any(counts[x] > 0 for x in REOPENED[name][0]):
            pop_to(*REOPENED[name])
        if name in VOID or rest.endswith("/") and name not in INLINE | ENDS_P:
            continue
        element = _open(name, rest, stack[-1])
        if line and (element.chrome, element.level) != (stack[-1].chrome, stack[-1].level):
            flush()
        stack.append(element)
        counts[name] += 1
    flush()
    return out


def roles(page: str) -> tuple[bool, list[str], list[str]]:
    """(declares an article, blocks to keep, all other blocks).  Without a declaration the blocks
    that are no chrome are kept for now."""
    found = blocks(page)
    level = max((lv for chrome, lv, _ in found if not chrome), default=0)
    kept, others = [], []
    for chrome, lv, text in found:
        (kept if not chrome and lv >= level else others).append(text)
    return level > 0, kept, others


class Codes(dict):
    """64-bit codes of tokens, the same in every task; those of the last tokens are kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return code


CODES = Codes()


def token_codes(words: list[str]) -> np.ndarray:
    return np.array([CODES[w] for w in words], dtype=np.uint64)


def prefix_keys(codes: np.ndarray, host: int, length: int) -> np.ndarray:
    """Key of every suffix with at least ``length`` tokens: host and first ``length`` tokens."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = np.full(n, host, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            key = (key ^ codes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _host(url: str | None) -> int:
    m = HOST.match(url or "")
    return int.from_bytes(hashlib.blake2b((m[1].lower() if m else "").encode(), digest_size=8).digest(), "little")


def read_pages(pages: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per page: row, page_id, url, declared, kept (blocks), keys (its suffixes), content (a hash).  A suffix
    runs over the page's stream: the blocks outside the declared article, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols = {c: [] for c in ("declared", "kept", "keys", "content")}
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                declared, kept, others = roles(page or "")
                stream = " ".join(others if declared else kept + others).split(" ")
                cols["declared"].append(declared)
                cols["kept"].append(kept)
                cols["keys"].append(np.unique(prefix_keys(token_codes(stream), _host(url), length)))
                cols["content"].append(int.from_bytes(hashlib.blake2b("\n".join(kept + others).encode("utf-8", "surrogatepass"),
                                                                      digest_size=8).digest(), "little", signed=True))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(1), pa.array(cols["declared"]),
                 pa.array(cols["kept"], pa.list_(pa.string())), pa.array(cols["keys"], pa.list_(pa.int64())),
                 pa.array(cols["content"], pa.int64())],
                names=["row", "page_id", "url", "declared", "kept", "keys", "content"])
            row += n

    kind = pages.schema["page_id"].dataType.simpleString()
    return common.write_shared(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, f"row bigint, page_id {kind}, url string, declared boolean, kept array<string>, keys array<bigint>, content bigint"),
        "pages")


def repeated_strings(read: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key) of the strings on ``min_pages`` pages of different content.  Pages are counted in two steps, so a
    string on a third of all pages costs a row per task and content."""
    suffixes = read.select("content", F.explode("keys").alias("key")).groupBy("key", "content").agg(F.lit(1).alias("one"))
    return suffixes.groupBy("key").agg(F.sum("one").alias("pages")).filter(F.col("pages") >= min_pages).select("key")


def repeated_tokens(words: list[str], host: int, repeated: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True per token that a repeated string covers."""
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    hit = np.flatnonzero(np.isin(prefix_keys(token_codes(words), host, length), repeated))
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + length, -1)
    return np.cumsum(covered)[:len(words)] > 0


def key_filter(repeated: DataFrame) -> np.ndarray:
    """Bits, two for every repeated key, of 16 to 32 a key and of ``FILTER_BITS`` at most: a key without both is not repeated."""
    n = repeated.count()
    size = min(max(1 << 15, 1 << (16 * n).bit_length()), FILTER_BITS)
    at = F.explode(F.array(*[c.bitwiseAND(F.lit(size - 1)) + 1 for c in (F.col("key"), F.shiftrightunsigned("key", 32))]))
    rows = repeated.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for bucket, bits in rows:
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def may_be_in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False only for keys that are not among those of the filter."""
    mask, out = np.uint64(8 * len(bits) - 1), np.ones(len(keys), dtype=bool)
    for shift in (0, 32):
        at = (keys.view(np.uint64) >> np.uint64(shift)) & mask
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def asked_strings(read: DataFrame, bits: np.ndarray, length: int = LENGTH) -> DataFrame:
    """(row, key) of the strings in the kept text of every page, but for those the filter rules out."""
    sent = read.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(prefix_keys(token_codes(" ".join(kept).split(" ")), _host(url), length))
                    for url, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keys = [k[may_be_in(k, sent.value)] for k in keys]
            rows = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64())],
                                             names=["row", "key"])

    return read.select("row", "url", "kept").mapInArrow(run, "row bigint, key bigint")


def extract(pages: DataFrame, length: int = LENGTH, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars, n_repeated."""
    read = read_pages(pages, length)
    repeated = common.write_shared(repeated_strings(read, min_pages), "repeated")
    asked = asked_strings(read, key_filter(repeated), length)  # nearly all that is left of a page's suffixes is repeated
    # written: its size is then known, and a small table is sent to the pages instead of moving these
    hits = common.write_shared(asked.join(repeated, "key").groupBy("row").agg(F.collect_list("key").alias("hits")), "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marked = [], []
            for url, declared, kept, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                text, n = " ".join(kept), 0
                if found:
                    words = text.split(" ")
                    gone = repeated_tokens(words, _host(url), np.array(found, dtype=np.int64), length)
                    n = int(gone.sum())
                    if not declared:  # the exact check: a declared article keeps its repeated runs
                        text = " ".join(w for w, g in zip(words, gone.tolist()) if not g)
                texts.append(text)
                marked.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(marked, pa.int64())],
                                             names=["page_id", "url", "text", "n_repeated"])

    kind = read.schema["page_id"].dataType.simpleString()
    out = read.select("row", "page_id", "url", "declared", "kept").join(hits, "row", "left").select(
        "page_id", "url", "declared", "kept", "hits").mapInArrow(run, f"page_id {kind}, url string, text string, n_repeated bigint")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages (one row per page)."""
    return extract(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))
