"""Exact k-nearest-neighbour join on a table of vectors, and the resampling built on it.

Rows are dealt into Voronoi cells around a bounded set of pivots, and each cell, sorted by distance to its pivot, into
blocks of at most ``block`` rows; so a hot cell is many blocks with narrow distance ranges.  A row's own block gives an
upper bound of its k-th distance.  By the triangle inequality a block (pivot p, distances to p from r0 to r1) holds no
closer row if |q - p| lies outside [r0 - bound, r1 + bound], nor if the plane between both pivots is farther than
the bound.  The blocks, in order, are dealt into a few runs, and a task takes a square of two runs: it holds the rows that ask, streams the
blocks that they have to visit past them, and sends at most k rows per query row.  So a vector is stored once per run and not once per
pair of blocks, and neither all pairs nor a cell ever meet in one place.

Distances are Euclidean in double precision; ties go to the smaller key.  Rows without a key or vector are left out; keys are
unique; rows have neighbours among the other rows, of their own group where ``by`` is given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .propagate import matrix, to_double_array
from .stats import _cumulative_before
from .validity import _zero

PIVOTS = 64
BLOCK = 256
# Summaries of blocks (a few numbers each) that every task holds; blocks grow so that there are no more.
MAX_BLOCKS = 200_000
# Runs of blocks: at least so many rows, so many runs unless a run would hold more than HELD numbers.  A vector is stored twice per run.
PART_ROWS, PARTS, HELD = 4096, 4, 1 << 24


def _draw(seed: int, name: str, *cols) -> Column:
    """Uniform draw in [0, 1) from the MD5 of seed, name and the values."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _vector(df: DataFrame, x: str) -> Column:
    """The vectors as they are stored where they hold floats or doubles (distances are double precision either way)."""
    return F.col(x) if df.schema[x].dataType.elementType.typeName() in ("float", "double") else to_double_array(x)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b`` (differences first: equal rows are at exactly 0)."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(a), 64):
        diff = a[at:at + 64, None, :] - b[None, :, :]
        out[at:at + 64] = np.sqrt((diff * diff).sum(axis=2))
    return out


def blocks_of(df: DataFrame, key: str, x: str, by: str | None = None, pivots: int = PIVOTS, block: int = BLOCK,
              seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(block table, pivots): a row per block with bid, grp, cell, n, low, high and its rows (key, x)."""
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.filter(F.col(key).isNotNull() & F.col(x).isNotNull()).select(
        F.col(key).alias("key"), F.coalesce(group, F.lit("")).alias("grp"), _vector(df, x).alias("x"))
    chosen = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))), "key").limit(pivots)
    centres = np.array([r["x"] for r in chosen.select("x").collect()])  # at most ``pivots`` rows
    kind, vector = (rows.schema[c].dataType.simpleString() for c in ("key", "x"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = _far(matrix(b.column(2)), centres) if b.num_rows else np.zeros((0, max(len(centres), 1)))
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])],
                                             names=["key", "grp", "x", "cell", "r"])

    dealt = rows.mapInArrow(assign, f"key {kind}, grp string, x {vector}, cell int, r double").withColumn("one", F.lit(1))
    placed = _cumulative_before(dealt, ["grp", "cell"], "r", "one").drop("one")
    total = placed.count()
    size = max(block, math.ceil(total / MAX_BLOCKS))
    blocks = placed.groupBy("grp", "cell", F.floor(F.col("before") / size).alias("nth")).agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"),
        F.array_sort(F.collect_list(F.struct("key", "x"))).alias("rows"))  # at most ``size`` rows
    return cut_lineage(blocks.withColumn("bid", F.monotonically_increasing_id())), centres


class _Summary:
    """Blocks in the order of group, cell and distance, dealt into ``parts`` runs of about equal rows."""

    def __init__(self, blocks: DataFrame, centres: np.ndarray, held: int):
        rows = sorted(blocks.select("bid", "grp", "cell", "low", "high", "n").collect(),  # at most MAX_BLOCKS and one per cell
                      key=lambda r: (r["grp"], r["cell"], r["low"], r["bid"]))
        column = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
        self.at = {r["bid"]: i for i, r in enumerate(rows)}
        self.bid, self.n, self.cell = column("bid", np.int64), column("n", np.int64), column("cell", np.int64)
        self.low, self.high = column("low", float), column("high", float)
        self.grp = np.unique(column("grp", object), return_inverse=True)[1] if rows else np.zeros(0, int)
        total = int(self.n.sum())
        self.parts = max(min(PARTS, -(-total // PART_ROWS)), -(-total // held), 1)
        self.part = (np.cumsum(self.n) - self.n) * self.parts // max(total, 1)
        self.between = _far(centres, centres) if len(centres) else np.zeros((0, 0))

    def needed(self, block: int, to_pivot: np.ndarray, reach: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the blocks ``others`` may hold a row within reach of a row of ``block``, whose distances to the pivots are given."""
        out = []
        for lo in range(0, len(others), 4096):
            some = others[lo:lo + 4096]
            far, gap = to_pivot[:, self.cell[some]], self.between[self.cell[block], self.cell[some]]
            least = np.maximum(self.low[some] - far, far - self.high[some])
            plane = (far ** 2 - to_pivot[:, [self.cell[block]]] ** 2) / np.where(gap > 0, 2 * gap, np.inf)
            out.append((np.maximum(least, plane) <= reach[:, None]).any(axis=0) & (self.grp[some] == self.grp[block]))
        return np.concatenate(out) if out else np.zeros(0, bool)


def _reach(x: np.ndarray, k: int) -> np.ndarray:
    """Upper bound of the k-th distance of the rows of one block (infinite: none known)."""
    own = _far(x, x)
    np.fill_diagonal(own, np.inf)
    bound = np.sort(own, axis=1)[:, k - 1] if len(x) > k else np.full(len(x), np.inf)
    return bound * (1 + 1e-12) + 1e-12  # rounding never hides a neighbour


def block_routes(blocks: DataFrame, centres: np.ndarray, k: int, summary: _Summary) -> DataFrame:
    """(side, bid, i, j, pairs, distances): the squares (i, j) of runs of blocks in which a block takes part, with side 0 as the
    one that asks and with side 1 as one that is visited; pairs and distances count its visits, once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        visited = np.zeros((summary.parts, len(summary.bid)), dtype=bool)
        every = np.arange(len(summary.bid))
        for b in batches:
            for row in range(b.num_rows):
                at = summary.at[b.column(0)[row].as_py()]
                x = matrix(b.column(1).slice(row, 1).flatten().field("x"))
                need = summary.needed(at, _far(x, centres), _reach(x, k), every)
                visited[summary.part[at]] |= need
                work = (int(need.sum()), int(summary.n[need].sum()) * len(x))
                for j in np.unique(summary.part[need]).tolist():
                    out.append((0, int(summary.bid[at]), int(summary.part[at]), j, *work))
                    work = (0, 0)
        for i, d in zip(*(v.tolist() for v in np.nonzero(visited))):
            out.append((1, int(summary.bid[d]), i, int(summary.part[d]), 0, 0))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)],
                                         names=["side", "bid", "i", "j", "pairs", "distances"])

    return cut_lineage(blocks.select("bid", "rows").mapInArrow(run, "side int, bid bigint, i int, j int, pairs bigint, distances bigint").distinct())


def _order(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys


class _Best:
    """The k nearest rows so far of the rows of one run, block by block; ties go to the smaller key."""

    def __init__(self, rows: pa.Table, k: int, summary: _Summary, centres: np.ndarray):
        self.k, self.summary = k, summary
        self.x, self.keys = matrix(rows.column("x")), _keys(rows.column("key"))
        bids = rows.column("bid").to_numpy()
        cut = [*np.flatnonzero(np.diff(bids, prepend=bids[0] - 1)).tolist(), len(bids)]
        self.blocks = [(lo, hi, summary.at[int(bids[lo])]) for lo, hi in zip(cut, cut[1:])]
        self.square = (self.x * self.x).sum(axis=1)
        self.reach, self.to_pivot = np.zeros(len(bids)), _far(self.x, centres)
        for lo, hi, _ in self.blocks:
            self.reach[lo:hi] = _reach(self.x[lo:hi], k)
        self.bound = self.reach.copy()
        self.found: list = [None] * len(self.blocks)  # (row, distance, key) by row, distance and key

    def meet(self, rows: pa.Table) -> None:
        x, keys, bids = matrix(rows.column("x")), _keys(rows.column("key")), rows.column("bid").to_numpy()
        square, order = (x * x).sum(axis=1), _order(keys)
        here, inverse = np.unique(bids, return_inverse=True)
        here = np.array([self.summary.at[v] for v in here.tolist()])
        same: dict = {}
        for c in np.flatnonzero(np.append((keys[1:] != keys[:-1]) | (bids[1:] != bids[:-1]), True)).tolist():
            same.setdefault(keys[c], []).append(c)  # a row is not its own neighbour
        for nth, (lo, hi, at) in enumerate(self.blocks):
            need = self.summary.needed(at, self.to_pivot[lo:hi], self.reach[lo:hi], here)
            cols = None if need.all() else np.flatnonzero(need[inverse])
            if cols is not None and not len(cols):
                continue
            other, size = (x, square) if cols is None else (x[cols], square[cols])
            # products find the candidates; differences, exact for equal rows, decide on them
            far = self.square[lo:hi, None] + size[None, :] - 2 * (self.x[lo:hi] @ other.T)
            for r, key in enumerate(self.keys[lo:hi].tolist()):
                for c in same.get(key, ()):
                    if cols is None:
                        far[r, c] = np.inf
                    elif (p := int(np.searchsorted(cols, c))) < len(cols) and cols[p] == c:
                        far[r, p] = np.inf
            slack = 1e-11 * (self.square[lo:hi] + size.max())
            limit = self.bound[lo:hi] ** 2 + slack
            close = far <= limit[:, None]
            if close.sum() > 8 * self.k * (hi - lo) and far.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(far, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
                close = far <= limit[:, None]
            r, c = np.nonzero(close & ~np.isinf(far))
            c = c if cols is None else cols[c]
            value = np.empty(len(r))
            for a in range(0, len(r), 65536):
                diff = self.x[lo + r[a:a + 65536]] - x[c[a:a + 65536]]
                value[a:a + 65536] = np.sqrt((diff * diff).sum(axis=1))
            fits = value <= self.bound[lo + r]
            if fits.any():
                self.keep(nth, lo, r[fits], value[fits], keys[c[fits]], order[c[fits]])

    def keep(self, nth: int, lo: int, r: np.ndarray, value: np.ndarray, keys: np.ndarray, order: np.ndarray) -> None:
        def first(r, value, order):
            """Places of the k first of each row."""
            place = np.lexsort((order, value, r))
            start = np.flatnonzero(np.diff(r[place], prepend=-1))
            count = np.diff(np.append(start, len(place)))
            return place[np.arange(len(place)) - np.repeat(start, count) < self.k]

        chosen = first(r, value, order)
        r, value, keys = r[chosen], value[chosen], keys[chosen]
        if self.found[nth] is not None:
            r, value, keys = (np.concatenate(p) for p in zip(self.found[nth], (r, value, keys)))
            chosen = first(r, value, _order(keys))
            r, value, keys = r[chosen], value[chosen], keys[chosen]
        self.found[nth] = (r, value, keys)
        full = np.flatnonzero(np.append(np.diff(r), 1))  # last entry of each row
        full = full[np.bincount(r, minlength=1)[r[full]] >= self.k]
        self.bound[lo + r[full]] = np.minimum(self.bound[lo + r[full]], value[full])

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for (lo, _, _), found in zip(self.blocks, self.found):
            if found is not None:
                r, value, keys = found
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[lo + r].tolist(), kind), pa.array(keys.tolist(), kind), pa.array(value)],
                                                 names=["key", "neighbour", "distance"])


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def nearest(df: DataFrame, key: str, x: str, k: int, by: str | None = None, pivots: int = PIVOTS, block: int = BLOCK,
            seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(neighbours, work): (key, nth, neighbour, distance) for nth = 1 .. k (fewer where a group has fewer rows), and one
    row with the block pairs visited, the distances computed and those of all pairs."""
    blocks, centres = blocks_of(df, key, x, by, pivots, block, seed)
    kind = blocks.schema["rows"].dataType.elementType["key"].dataType.simpleString()
    summary = _Summary(blocks, centres, HELD // max(centres.shape[-1] if centres.size else 1, 1))
    routes = block_routes(blocks, centres, k, summary)
    square = F.col("i") * F.lit(summary.parts) + F.col("j")
    sent = routes.join(blocks.select("bid", "rows"), "bid").select(
        square.cast("int").alias("square"), "side", "bid", F.explode("rows").alias("r")).select("square", "side", "bid", "r.key", "r.x")
    met = sent.repartitionById(summary.parts ** 2, F.col("square")).sortWithinPartitions("square", "side", "bid", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, now = [], None, None
        for b in batches:
            part = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cut = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            for lo, hi in zip(cut, cut[1:]):
                rows = pa.Table.from_batches([b.slice(lo, hi - lo)])
                if now is not None and part[lo] // 2 != now and best is not None:
                    yield from best.rows(rows.schema.field("key").type)
                    held, best = [], None
                now, last = part[lo] // 2, rows.schema.field("key").type
                if part[lo] % 2 == 0:
                    held.append(rows)
                else:
                    best = best or _Best(pa.concat_tables(held), k, summary, centres)
                    best.meet(rows)
        if best is not None:
            yield from best.rows(last)

    found = met.mapInArrow(run, f"key {kind}, neighbour {kind}, distance double")
    best = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("all"))  # at most k a run
    neighbours = best.select("key", F.posexplode("all").alias("pos", "r")).select(
        "key", (F.col("pos") + 1).alias("nth"), "r.neighbour", "r.distance")
    work = routes.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("block_pairs"), F.coalesce(F.sum("distances"), F.lit(0)).alias("distances"))
    whole = blocks.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("all_pairs"))
    return neighbours, work.withColumn("_k", _zero("distances")).join(whole.withColumn("_k", _zero("all_pairs")), "_k").drop("_k")


# --- D6, D7 --------------------------------------------------------------------------------------

def smote(df: DataFrame, key: str, x: str, label: str, k: int = 5, seed: int = 42, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Synthetic rows that raise every class to the size of the largest: (base, nth, label, neighbour, gap, x) with
    x = base + gap * (neighbour - base).  Draws go round the rows of a class in the order of their keys; the nth draw of a row takes
    one of its k nearest rows of the class and a gap, both from hashes of (seed, key, nth).  A class of one row repeats it.  Rows
    without key, vector or label are left out."""
    rows = cut_lineage(df.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).alias("label"), _vector(df, x).alias("x")))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("m")).first()["m"] or 0
    ranked = _cumulative_before(rows.select("key", "label", F.lit(1).alias("one")), ["label"], "key", "one")
    need = F.lit(largest) - F.col("n")
    quota = F.floor(need / F.col("n")) + (F.col("before") < need % F.col("n")).cast("long")
    bases = ranked.join(sizes, "label").select("key", "label", quota.alias("quota")).filter("quota > 0")
    draws = bases.select("key", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("nth"))
    near, _ = nearest(rows, "key", "x", k, "label", pivots, block, seed)
    near = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour"))).alias("near"))  # at most k
    pick = (F.floor(_draw(seed, "neighbour", "key", "nth") * F.size("near")) + 1).cast("int")
    drawn = draws.join(near, "key", "left").select(
        "key", "nth", "label", F.coalesce(F.element_at("near", pick)["neighbour"], F.col("key")).alias("neighbour"),
        _draw(seed, "gap", "key", "nth").alias("gap"))
    base = rows.select("key", F.col("x").alias("xb"))
    other = rows.select(F.col("key").alias("neighbour"), F.col("x").alias("xn"))
    mixed = F.zip_with(to_double_array("xb"), to_double_array("xn"), lambda a, b: a + F.col("gap") * (b - a))
    return drawn.join(base, "key").join(other, "neighbour").select(
        F.col("key").alias("base"), "nth", "label", "neighbour", "gap", mixed.alias("x"))


def edited(df: DataFrame, key: str, x: str, label: str, k: int = 3, seed: int = 42, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, label, agree, kept, kept_by_most): how many of a row's k nearest rows (of all classes) share its class; kept
    if all do, kept_by_most if the commonest class among them (the smallest of equals) is its own."""
    rows = cut_lineage(df.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).alias("label"), _vector(df, x).alias("x")))
    near, _ = nearest(rows, "key", "x", k, None, pivots, block, seed)
    classes = rows.select(F.col("key").alias("neighbour"), F.col("label").alias("theirs"))
    met = near.join(classes, "neighbour").join(rows.select("key", "label"), "key")
    votes = met.groupBy("key", "label", "theirs").agg(F.count(F.lit(1)).alias("n"))
    tally = votes.groupBy("key", "label").agg(
        F.coalesce(F.sum(F.when(F.col("theirs") == F.col("label"), F.col("n"))), F.lit(0)).alias("agree"), F.sum("n").alias("seen"),
        F.element_at(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "theirs"))), 1)["theirs"].alias("most"))  # at most k
    alone = rows.select("key", "label").join(tally.drop("label"), "key", "left")
    return alone.select("key", "label", F.coalesce("agree", F.lit(0)).alias("agree"),
                        F.coalesce(F.col("agree") == F.col("seen"), F.lit(True)).alias("kept"),
                        F.coalesce(F.col("most") == F.col("label"), F.lit(True)).alias("kept_by_most"))


def smote_enn(df: DataFrame, key: str, x: str, label: str, k_smote: int = 5, k_edit: int = 3, seed: int = 42) -> DataFrame:
    """Over- then under-sampling: (key string, label, x) of the rows and of the synthetic ones (``base#nth``) that
    the edited nearest neighbours keep."""
    rows = df.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(label).alias("label"), to_double_array(x).alias("x"))
    made = smote(df, key, x, label, k_smote, seed).select(
        F.concat(F.col("base").cast("string"), F.lit("#"), F.col("nth").cast("string")).alias("key"), "label", "x")
    both = cut_lineage(rows.unionByName(made))
    kept = edited(both, "key", "x", "label", k_edit, seed).filter("kept").select("key")
    return both.join(kept, "key", "left_semi")
