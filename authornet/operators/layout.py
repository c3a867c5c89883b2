"""Two-dimensional neighbour embedding (C5): attraction along the nearest-neighbour graph, repulsion summed on a grid.

Rows start from their two principal components.  An epoch moves every row along the gradient of the t-distributed
neighbour embedding: rows joined by an edge of the k-nearest-neighbour graph attract each other (one join and one aggregate
over the edges), and all rows repel each other through a grid: their masses are spread on its nodes, the kernel sums of
all nodes are a convolution of that bounded grid, and each row reads the field at its place.  No pairs of rows are
built, and an epoch is linear in rows and edges; the grid (``GRID`` nodes a side) is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .neighbours import nearest
from .validity import project_2d

GRID = 128
NEIGHBOURS, EPOCHS, EARLY, EXAGGERATION = 10, 25, 8, 4.0


def kernel_fields(cells: np.ndarray, step: float) -> np.ndarray:
    """``cells``: (3, g, g) masses and masses times coordinates.  Returns (4, g, g): at each node the sums over all nodes of
    mass / (1 + d^2), and of mass, mass * x and mass * y / (1 + d^2)^2."""
    g = cells.shape[1]
    at = np.arange(-g, g) * step
    near = 1 / (1 + at[:, None] ** 2 + at[None, :] ** 2)
    turn = lambda k: np.fft.rfft2(np.fft.ifftshift(k))
    first, second = turn(near), turn(near ** 2)
    spread = np.fft.rfft2(cells, s=(2 * g, 2 * g), axes=(1, 2))
    out = np.concatenate([spread[:1] * first, spread * second])
    return np.fft.irfft2(out, s=(2 * g, 2 * g), axes=(1, 2))[:, :g, :g]


def _corners(y: np.ndarray, low: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (n, 4) around each row and their bilinear weights."""
    place = (y - low) / step
    base = np.clip(np.floor(place).astype(int), 0, GRID - 2)
    part = place - base
    nodes = np.stack([(base[:, 0] + a) * GRID + base[:, 1] + b for a in (0, 1) for b in (0, 1)], axis=1)
    weights = np.stack([(part[:, 0] if a else 1 - part[:, 0]) * (part[:, 1] if b else 1 - part[:, 1]) for a in (0, 1) for b in (0, 1)], axis=1)
    return nodes, weights


def _grid(state: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int, float]:
    """(fields, low corner, step, rows, normaliser) of the current places."""
    r = state.agg(F.min("y0"), F.max("y0"), F.min("y1"), F.max("y1"), F.count(F.lit(1))).first()
    low, n = np.array([r[0], r[2]]), r[4]
    step = max(r[1] - r[0], r[3] - r[2], 1e-6) / (GRID - 1) * (1 + 1e-9)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GRID * GRID, 3))
        for b in batches:
            y = np.stack([b.column(i).to_numpy() for i in (0, 1)], axis=1)
            nodes, w = _corners(y, low, step)
            for c, part in enumerate((w, w * y[:, :1], w * y[:, 1:])):
                total[:, c] += np.bincount(nodes.ravel(), part.ravel(), GRID * GRID)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, c]) for c in range(3)]], names=["cell", "m", "mx", "my"])

    cells = np.zeros((3, GRID * GRID))
    sums = state.select("y0", "y1").mapInArrow(spread, "cell bigint, m double, mx double, my double").groupBy("cell").agg(
        F.sum("m").alias("m"), F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    for c in sums.collect():  # at most GRID x GRID rows
        cells[:, c["cell"]] = (c["m"], c["mx"], c["my"])
    fields = kernel_fields(cells.reshape(3, GRID, GRID), step).reshape(4, -1)
    # the normaliser: kernel sums over all ordered pairs, without each row's own
    return fields, low, step, n, max(float((cells[0] * fields[0]).sum()) - n, 1e-9)


def neighbour_layout(df: DataFrame, key: str = "vec_id", x: str = "embedding", k: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 42,
                     pivots: int = 64, block: int = 256) -> DataFrame:
    """(key, y0, y1).  Rows without key or vector are left out; fewer than three rows stay at their principal components."""
    rows = cut_lineage(df.filter(F.col(key).isNotNull() & F.col(x).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x")))
    n = rows.count()
    if n < 3:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    near, _ = nearest(rows, "key", "x", k, None, pivots, block, seed)
    one = near.select(F.col("key").alias("src"), F.col("neighbour").alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # weights of both directions, summing to 1 over all ordered pairs
    edges = cut_lineage(both.groupBy("src", "dst").agg((F.count(F.lit(1)) / F.lit(2.0 * n * min(k, n - 1))).alias("p")))
    start = project_2d(rows, "x", "key")
    size = start.agg(F.stddev_pop("pc1")).first()[0] or 1.0
    state = cut_lineage(start.select("key", (F.col("pc1") / size).alias("y0"), (F.col("pc2") / size).alias("y1"),
                                     F.lit(0.0).alias("v0"), F.lit(0.0).alias("v1")))
    for epoch in range(epochs):
        state = _stored(_epoch(state, edges, EXAGGERATION if epoch < EARLY else 1.0, 0.5 if epoch < EARLY else 0.8))
    return state.select(F.col("key").alias(key), "y0", "y1")


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back.  A checkpoint would hand the plan's constraints on, whose number doubles
    with every epoch."""
    path = scratch_path(df.sparkSession, "layout")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _epoch(state: DataFrame, edges: DataFrame, stress: float, momentum: float) -> DataFrame:
    fields, low, step, n, z = _grid(state)

    def read(y: np.ndarray) -> np.ndarray:
        nodes, w = _corners(y, low, step)
        return (fields[:, nodes] * w).sum(axis=2)

    at = F.struct("y0", "y1")
    met = edges.join(state.select(F.col("key").alias("src"), at.alias("a")), "src").join(state.select(F.col("key").alias("dst"), at.alias("b")), "dst")
    d0, d1 = F.col("a.y0") - F.col("b.y0"), F.col("a.y1") - F.col("b.y1")
    pull = met.select("src", (F.col("p") / (1 + d0 * d0 + d1 * d1)).alias("w"), d0.alias("d0"), d1.alias("d1")).groupBy(F.col("src").alias("key")).agg(
        F.sum(F.col("w") * F.col("d0")).alias("f0"), F.sum(F.col("w") * F.col("d1")).alias("f1"))
    kind = state.schema["key"].dataType.simpleString()

    rate = max(float(n), 10.0)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, v, f = (np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in c], axis=1) for c in ((1, 2), (3, 4), (5, 6)))
            _, m, mx, my = read(y)
            push = (y * m[:, None] - np.stack([mx, my], axis=1)) / z
            v = momentum * v - rate * 4 * (stress * f - push)
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v *= np.minimum(1.0, 5.0 / np.maximum(length, 1e-12))  # no row leaps over the map
            y = y + v
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in (*y.T, *v.T)]], names=["key", "y0", "y1", "v0", "v1"])

    joined = state.join(pull, "key", "left").select("key", "y0", "y1", "v0", "v1", F.coalesce("f0", F.lit(0.0)).alias("f0"),
                                                    F.coalesce("f1", F.lit(0.0)).alias("f1"))
    return joined.mapInArrow(move, f"key {kind}, y0 double, y1 double, v0 double, v1 double")
