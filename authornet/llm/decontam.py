"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised items is built over word numbers.  A document's words are streamed
through it; the state and the length of the longest match ending at each word say whether a window
(``window`` consecutive words of an item, or a whole shorter item) ends there, and which items
hold it.  Words unknown to every item reset the match, so only runs of known words long enough
for a window are walked at all; finding them is vectorised.

The items are collected only after their size was measured.  Above ``part_bytes`` they are split by a hash
into parts; each part's automaton is built in a task and written to the shared folder, and has a pass of its own whose
hits are written before the next, so the driver holds no items and one automaton of bounded size at a time.  The hits
of the passes are united per row.

Edge cases: null texts have no words; an item without a word matches nothing; items of equal text
all count; an empty benchmark leaves every document clean; an empty table gives an empty result;
repeated rows are judged each; extra columns are ignored (or kept, by ``decontaminate``).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import common

WINDOW = 13
PART_BYTES = 1 << 20
# contaminated: at least one word in COVERAGE is hit
COVERAGE = 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(c if c >= 0x80 or c in _KEEP else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and everything beyond ASCII."""
    return (text or "").encode().translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences; one per part of the benchmark."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ends: list[list[int]] = []
        for _, text in items:
            last, path = 0, []
            for w in words_of(text):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                path.append(last)
            ends.append(path)
        # state of the window-long suffix of each state's strings
        self.root_of_window = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.root_of_window[v] = v if self.length[up] < window else self.root_of_window[up]
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        for k, path in enumerate(ends):
            if 0 < len(path) < window:
                self.short.setdefault(path[-1], []).append((len(path), k))
                self.least = min(self.least, len(path))
            for state in path[window - 1:]:
                self.holders.setdefault(self.root_of_window[state], set()).add(k)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """([(first word, end)] of the hit spans, disjoint and in order; items found)."""
        if not self.vocab or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.least
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for s, e in zip(starts[long].tolist(), stops[long].tolist()):
            self._walk(ids[s:e].tolist(), s, spans, items)
        return spans, items

    def _walk(self, ids: list[int], base: int, spans: list, items: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(ids, base + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            reach = 0
            if matched >= window:
                reach = matched
                items |= self.holders[self.root_of_window[state]]
            if self.short:
                up = state
                while up > 0:
                    for n, k in self.short.get(up, ()):
                        if n <= matched:
                            items.add(k)
                            reach = max(reach, n)
                    up = link[up]
            if reach:
                first = i - reach
                while spans and spans[-1][1] >= first:  # unite with what it touches
                    first = min(first, spans.pop()[0])
                spans.append((first, i))


def automata(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> tuple[int, Iterator[bytes]]:
    """(number of parts, one pickled automaton for each); parts are bounded by ``part_bytes``.  Several are built
    in tasks and read from the shared folder one after the other."""
    items = common.texts(benchmark.withColumn("item", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), "item")
    items = items.withColumnRenamed("doc_id", "item")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // part_bytes) or 1
    if parts == 1:
        return 1, iter([cloudpickle.dumps(Automaton(sorted((r["item"], r["text"]) for r in items.collect()), window))])
    make = common.send(benchmark.sparkSession, Automaton)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        auto = make()(sorted(zip(rows["item"].to_pylist(), rows["text"].to_pylist())), window)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "auto": pa.array([cloudpickle.dumps(auto)], pa.binary())})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("long"))
    built = common.write_shared(dealt.groupBy("part").applyInArrow(build, "part bigint, auto binary"), "automata")
    numbers = sorted(r["part"] for r in built.select("part").collect())
    return len(numbers), (built.filter(F.col("part") == k).first()["auto"] for k in numbers)


def _passes(rows: DataFrame, autos: Iterator[bytes]) -> DataFrame:
    """The results of one pass per automaton over stored rows, each written before the next: all rows in the
    first, rows with hits in the others."""
    spark = rows.sparkSession
    path = scratch_path(spark, "llm-hits")
    schema = None
    for auto in autos:
        sent = spark.sparkContext.broadcast(auto)
        out = _pass(rows, sent)
        (out if schema is None else out.filter(F.size("hits") > 0)).write.mode("append").option("compression", "zstd").parquet(path)
        schema = out.schema
        sent.destroy()
    return spark.read.schema(schema).parquet(path)


def _pass(rows: DataFrame, model) -> DataFrame:
    """``model``: broadcast of a pickled automaton."""
    sent = lambda: pickle.loads(model.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent()
        for batch in batches:
            n_words, hits, found = [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                spans, items = auto.scan(words)
                n_words.append(len(words))
                hits.append([{"first": s, "end": e} for s, e in spans])
                found.append(sorted({auto.names[k] for k in items}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                 pa.array(found, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "hits", "items"])

    schema = "row bigint, doc_id bigint, n_words bigint, hits array<struct<first:bigint,end:bigint>>, items array<string>"
    return rows.mapInArrow(run, schema)


def find_hits(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, hits (array of [first, end) word spans), n_hit, items."""
    rows = common.texts(df).select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    n_parts, autos = automata(benchmark, window, part_bytes)
    if n_parts > 1:  # rows need a name under which the passes meet
        rows = common.write_shared(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        out = _passes(rows, autos)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                     F.flatten(F.collect_list("hits")).alias("hits"),
                                     F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        spot = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["first"], x["end"] - 1))))
        return out.withColumn("n_hit", F.size(spot).cast("long")).drop("row")
    out = _pass(rows, df.sparkSession.sparkContext.broadcast(next(autos)))
    length = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return out.withColumn("n_hit", length).drop("row")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (COVERAGE * n_hit >= n_words)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans and what lies between their words."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text.translate(LOWER))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at:places[first][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``df`` (all columns) without contaminated documents, and without
    the hit spans (each at least a window or a whole item long) in the others."""
    n_parts, autos = automata(benchmark, window, part_bytes)
    if n_parts == 1:
        return _cut(df, pickle.loads(next(autos)))
    row, hits = common.free_name(df, "row"), common.free_name(df, "hits")
    rows = common.write_shared(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = rows.select(F.col(row).alias("row"), F.lit(0).cast("long").alias("doc_id"), "text")
    out = _passes(narrow, autos)
    found = out.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("hits")).alias(hits))
    return _cut(rows.join(found, row).drop(row), None, hits)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(df: DataFrame, auto: Automaton | None, hits: str | None = None) -> DataFrame:
    """Drop contaminated rows and cut the spans of the others; the spans come from
    ``auto``, or from the column ``hits`` where several passes have found them."""
    sent = common.send(df.sparkSession, auto)
    schema = df.drop(hits).schema if hits else df.schema
    names = schema.names
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent()
        for batch in batches:
            given = batch.column(len(names)).to_pylist() if hits else None
            cols = [batch.column(k) for k in range(len(names))]
            keep, changed = [], {}
            for i, t in enumerate(cols[at].to_pylist()):
                words = words_of(t)
                spans = _united([(h["first"], h["end"]) for h in given[i]]) if hits else auto.scan(words)[0]
                n_hit = sum(e - s for s, e in spans)
                keep.append(not (n_hit and COVERAGE * n_hit >= len(words)))
                if n_hit and keep[-1]:
                    changed[i] = cut_words(t, spans)
            if changed:
                cols[at] = _replaced(cols[at], changed)
                if counted is not None:
                    cols[counted] = _replaced(cols[counted], {i: len(t) for i, t in changed.items()})
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    if hits:
        df = df.select(*names, hits)
    return df.mapInArrow(run, schema)


def _replaced(column: pa.Array, changed: dict) -> pa.Array:
    values = column.to_pylist()
    for i, v in changed.items():
        values[i] = v
    return pa.array(values, column.type)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in every document."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hits = find_hits(common.documents(spark, sf_dir), bench)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
