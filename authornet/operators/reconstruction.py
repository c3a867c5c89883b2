"""Reconstruction loss of the inner-product decoder over all cells of the adjacency matrix (N8), and the
total loss (N12), without a table of pairs.

The loss is the mean over all N x N cells of (sigmoid(z_i . z_j) - a_ij)^2.  Its square part depends on every
pair, but rows are unit vectors, so z_i . z_j lies in [-1, 1], where the squared sigmoid is a polynomial within
``bound(degree)``.  Each power sums over all pairs as the squared length of a moment tensor,

    sum_ij (z_i . z_j)^k = sum over monomials m of degree k of multinomial(m) * (sum_i m(z_i))^2,

so one pass that sums the monomials of degree up to ``degree`` replaces the pairs.  The terms with a_ij run
over the edges alone.  Their number is C(d + degree, degree): 1,365 for 4 dimensions and degree 11, 11,440 for 9 and 7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .propagate import _dot, _width, kl, matrix, target_distribution
from .validity import _zero, silhouette

# Default degree of the polynomial; the largest error on [-1, 1] falls about thirtyfold with every second degree.
DEGREE = 11
# A table of this many monomials is refused: choose a lower degree.
MAX_MONOMIALS = 250_000
# Cells of one block of rows x monomials in a task (32 MB).
BLOCK_CELLS = 1 << 22


def squared_sigmoid(t):
    return (1.0 / (1.0 + np.exp(-t))) ** 2


@lru_cache
def coefficients(degree: int) -> np.ndarray:
    """Power-series coefficients of the polynomial through the Chebyshev points."""
    c = np.polynomial.Chebyshev.interpolate(squared_sigmoid, degree, domain=[-1, 1])
    out = np.zeros(degree + 1)
    power = c.convert(kind=np.polynomial.Polynomial).coef
    out[:len(power)] = power
    return out


def bound(degree: int) -> float:
    """Largest error of the squared sigmoid on [-1, 1], and so of the loss (measured on 20,001 points)."""
    t = np.linspace(-1, 1, 20_001)
    return float(np.abs(np.polynomial.polynomial.polyval(t, coefficients(degree)) - squared_sigmoid(t)).max())


class Monomials:
    """All monomials of ``d`` variables up to ``degree``, by degree; each is a lower one times a variable."""

    def __init__(self, d: int, degree: int):
        if math.comb(d + degree, degree) > MAX_MONOMIALS:
            raise ValueError(f"{math.comb(d + degree, degree)} monomials of {d} dimensions and degree {degree}; choose a lower degree")
        self.d, self.degree = d, degree
        listed = [m for k in range(degree + 1) for m in combinations_with_replacement(range(d), k)]
        number = {m: i for i, m in enumerate(listed)}
        self.parent = np.array([number[m[:-1]] if m else 0 for m in listed])
        self.variable = np.array([m[-1] if m else 0 for m in listed])
        self.order = np.array([len(m) for m in listed])
        self.powers = np.array([[m.count(r) for r in range(d)] for m in listed]).reshape(len(listed), d)
        self.multinomial = np.array([math.factorial(len(m)) / math.prod(math.factorial(m.count(r)) for r in set(m)) for m in listed])
        # for each monomial below the top degree and each variable: the product of both
        self.below = int((self.order < degree).sum())
        self.times = np.array([[number[tuple(sorted((*m, r)))] for r in range(d)] for m in listed[:self.below]]).reshape(self.below, d)

    def __len__(self) -> int:
        return len(self.order)

    def values(self, z: np.ndarray, count: int | None = None) -> np.ndarray:
        """Rows of ``z`` x monomials (the first ``count`` of them)."""
        count = len(self) if count is None else count
        out = np.ones((len(z), count))
        for k in range(1, self.degree + 1):
            here = np.flatnonzero(self.order[:count] == k)
            if len(here):
                out[:, here] = out[:, self.parent[here]] * z[:, self.variable[here]]
        return out

    def weights(self, moments: np.ndarray) -> np.ndarray:
        """Coefficients of P(z) = sum_j p(z . z_j) as a polynomial in z."""
        return coefficients(self.degree)[self.order] * self.multinomial * moments

    def pair_sum(self, moments: np.ndarray) -> float:
        """sum_ij p(z_i . z_j)."""
        return float((self.weights(moments) * moments).sum())

    def gradient(self, z: np.ndarray, moments: np.ndarray) -> np.ndarray:
        """Gradient of P at the rows of ``z``: the lower monomials times a bounded matrix."""
        slope = self.weights(moments)[self.times] * (self.powers[:self.below] + 1)
        step = max(1, BLOCK_CELLS // max(self.below, 1))
        return np.concatenate([self.values(z[at:at + step], self.below) @ slope for at in range(0, len(z), step)] or [z])


def moment_sums(z: DataFrame, degree: int = DEGREE, col: str = "z", by: str | None = None, width: int | None = None) -> DataFrame:
    """(by, i, v, n): the sum of every monomial over the rows, and the rows.  Tasks sum their rows and send one
    row per monomial, so what is shuffled does not grow with the rows."""
    basis = Monomials(width or _width(z, col), degree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        step = max(1, BLOCK_CELLS // len(basis))
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, basis.d))
            for key in np.unique(keys).tolist():
                own = values[keys == key]
                for at in range(0, len(own), step):
                    sums[key] = sums.get(key, 0.0) + basis.values(own[at:at + step]).sum(axis=0)
                rows[key] = rows.get(key, 0) + len(own)
        for key, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(total),
                                              pa.array([rows[key]] * n, pa.int64())], names=["by", "i", "v", "n"])

    keyed = z.select((F.col(by) if by else F.lit(0)).cast("long").alias("by"), F.col(col).alias("z"))
    parts = keyed.mapInArrow(run, "by bigint, i int, v double, n bigint")
    return parts.groupBy("by", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def moments_by(sums: DataFrame, basis: Monomials) -> dict[int, tuple[np.ndarray, int]]:
    """{by: (moments, rows)}, a bounded table."""
    out: dict[int, tuple[np.ndarray, int]] = {}
    for r in sums.collect():
        values, _ = out.setdefault(r["by"], (np.zeros(len(basis)), r["n"]))
        values[r["i"]] = r["v"]
    return out


def edge_terms(z: DataFrame, edges: DataFrame, key: str = "author", col: str = "z") -> DataFrame:
    """One row: cross = sum of sigmoid * a and square = sum of a^2 over both directions of the undirected
    ``edges`` (src, dst, weight)."""
    a = z.select(F.col(key).alias("src"), F.col(col).alias("zs"))
    b = z.select(F.col(key).alias("dst"), F.col(col).alias("zd"))
    w = F.col("weight").cast("double")
    sigma = 1.0 / (1.0 + F.exp(-_dot(F.col("zs"), F.col("zd"))))
    return edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(2 * w * sigma), F.lit(0.0)).alias("cross"),
                                                   F.coalesce(F.sum(2 * w * w), F.lit(0.0)).alias("square"))


def reconstruction_loss(z: DataFrame, edges: DataFrame, degree: int = DEGREE, key: str = "author", col: str = "z") -> DataFrame:
    """One row (nodes, mse, error_bound).  ``z``: unit rows, one per node; ``edges``: (src, dst, weight) with
    src < dst.  Null without nodes."""
    width = _width(z, col)
    if not width:
        return z.sparkSession.createDataFrame([(0, None, bound(degree))], "nodes bigint, mse double, error_bound double")
    basis = Monomials(width, degree)
    moments, n = moments_by(moment_sums(z, degree, col, width=width), basis)[0]
    pairs = basis.pair_sum(moments)
    mse = (F.lit(pairs) - 2 * F.col("cross") + F.col("square")) / F.lit(float(n) * float(n))
    return edge_terms(z, edges, key, col).select(F.lit(n).cast("long").alias("nodes"), mse.alias("mse"),
                                                 F.lit(bound(degree)).alias("error_bound"))


def total_loss(z: DataFrame, edges: DataFrame, q: DataFrame, labels: DataFrame, weight: float = 2.0, degree: int = DEGREE,
               key: str = "author", col: str = "z", index=None) -> DataFrame:
    """One row (kl, mse, silhouette, clusters, total) of one epoch: KL(P || Q) of the soft assignment ``q``, N8
    of ``z`` and the silhouette (``index``: a function like :func:`validity.silhouette`, its default) of the hard
    ``labels`` (key, cluster); total = kl + mse + weight * (1 - silhouette) / 2, null with a single cluster."""
    divergence = kl(target_distribution(q, key), q, key)
    mse = reconstruction_loss(z, edges, degree, key, col).select("mse")
    sil = (index or silhouette)(z.join(labels, key), col, "cluster", key)
    used = labels.agg(F.countDistinct("cluster").alias("clusters"))
    # four tables of one row each
    one = divergence.withColumn("_k", _zero("kl")).join(mse.withColumn("_k", _zero("mse")), "_k").join(
        sil.withColumn("_k", _zero("silhouette")), "_k").join(used.withColumn("_k", _zero("clusters")), "_k")
    total = F.when(F.col("clusters") > 1, F.col("kl") + F.col("mse") + weight * (1 - F.col("silhouette")) / 2)
    return one.select("kl", "mse", "silhouette", "clusters", total.alias("total"))
