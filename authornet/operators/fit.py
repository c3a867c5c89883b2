"""Fit of the attention encoder (N15), gradient statistics (N17) and random search.

Two attention layers and unit rows are fitted to the adjacency matrix by full-batch gradient steps on the
reconstruction loss (N8).  The state is a table of nodes with a row per (trial, node): all trials of a search share every
scan, join and job, told apart by a key column.  One epoch is

* forward, per layer: features times weights (a matrix product per Arrow batch), scores on the edges, a softmax per
  source, and one aggregate that sums the weighted neighbours;
* the decoder's gradient: a contraction of each row with the moments of all rows (no pairs) and an aggregate over the edges;
* backward, per layer: the gradients of the edge scores, one aggregate per source and one per target; weight gradients
  are summed as bounded partials per task.

Only weights, their gradients and moments (all bounded by the model's shape) reach the driver, where Adam updates them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .propagate import _dot, _width, matrix, seeded_weights
from .reconstruction import DEGREE, Monomials, moment_sums, moments_by

SLOPE = 0.05  # of the leaky rectifier on edge scores
NAMES = ("W0", "a_self0", "a_neighs0", "W1", "a_self1", "a_neighs1")
ROW = ["trial", "node"]


# --- arrays in and out of Arrow batches ------------------------------------------------------------

def _lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32), rows.ravel())


def _map(df: DataFrame, out: str, fn: Callable[[int, dict[str, np.ndarray]], dict[str, np.ndarray]], keys: list[str]) -> DataFrame:
    """Apply ``fn(trial, {column: array})`` to the rows of each trial of a batch; list columns are matrices.  ``keys``
    (the trial first) are carried over."""
    names = df.columns
    added = [part.split()[0] for part in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trials = batch.column(names.index("trial")).to_numpy(zero_copy_only=False)
            for trial in np.unique(trials).tolist():
                part = batch.take(pa.array(np.flatnonzero(trials == trial)))
                cols = {c: matrix(part.column(i)) if pa.types.is_list(part.column(i).type) else part.column(i).to_numpy(zero_copy_only=False)
                        for i, c in enumerate(names) if c not in keys}
                made = fn(int(trial), cols)
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index(k)) for k in keys] + [_lists(made[c]) if made[c].ndim == 2 else pa.array(made[c]) for c in added],
                    names=keys + added)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInArrow(run, f"{kinds}, {out}")


def _elu(s: np.ndarray) -> np.ndarray:
    return np.where(s > 0, s, np.expm1(np.minimum(s, 0)))


def _elu_slope(s: np.ndarray) -> np.ndarray:
    return np.where(s > 0, 1.0, np.exp(np.minimum(s, 0)))


def _wide(df: DataFrame, col: str, d: int, prefix: str) -> list[Column]:
    return [F.element_at(col, k + 1).alias(f"{prefix}{k}") for k in range(d)]


def _packed(prefix: str, d: int) -> Column:
    return F.array(*[F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) for k in range(d)])


# --- forward ---------------------------------------------------------------------------------------

def forward_layer(nodes: DataFrame, m: DataFrame, weights: dict[int, dict], layer: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (trial, node, x) -> edge table (trial, src, dst, m, z, ex) and node table (trial, node, x, h, tot, s):
    h = x W, z = m (h_src . a_self + h_dst . a_neighs), ex = exp(LeakyReLU(z) - its source's largest),
    tot = sum of ex, s = sum of ex h_dst / tot."""
    W = {t: w[f"W{layer}"] for t, w in weights.items()}
    a_s, a_n = ({t: w[f"{name}{layer}"] for t, w in weights.items()} for name in ("a_self", "a_neighs"))
    width = next(iter(W.values())).shape[1]

    def project(trial, c):
        h = c["x"] @ W[trial]
        return {"x": c["x"], "h": h, "f": h @ a_s[trial], "g": h @ a_n[trial]}

    own = cut_lineage(_map(nodes.select(*ROW, "x"), "x array<double>, h array<double>, f double, g double", project, ROW))
    scored = (m.join(own.select("trial", F.col("node").alias("src"), "f"), "src")
              .join(own.select("trial", F.col("node").alias("dst"), "g"), ["trial", "dst"])
              .withColumn("z", F.col("m") * (F.col("f") + F.col("g")))
              .withColumn("e", F.when(F.col("z") >= 0, F.col("z")).otherwise(SLOPE * F.col("z"))))
    top = scored.groupBy("trial", "src").agg(F.max("e").alias("top"))
    att = cut_lineage(scored.join(top, ["trial", "src"]).select("trial", "src", "dst", "m", "z", F.exp(F.col("e") - F.col("top")).alias("ex")))
    wide = own.select("trial", F.col("node").alias("dst"), *_wide(own, "h", width, "_h"))
    sums = att.join(wide, ["trial", "dst"]).groupBy("trial", F.col("src").alias("node")).agg(
        F.sum("ex").alias("tot"), *[F.sum(F.col("ex") * F.col(f"_h{k}")).alias(f"_s{k}") for k in range(width)])
    s = F.array(*[F.col(f"_s{k}") / F.col("tot") for k in range(width)])
    return att, cut_lineage(own.join(sums, ROW).select(*ROW, "x", "h", "tot", s.alias("s")))


def encode_trials(x: DataFrame, m: DataFrame, weights: dict[int, dict]) -> tuple[list, DataFrame]:
    """Both layers; returns [(edge table, node table) per layer] and the last node table with z (unit rows) and length."""
    trials = F.array(*[F.lit(t).cast("int") for t in sorted(weights)])
    first = x.select(F.explode(trials).alias("trial"), "node", "x")
    att0, nodes0 = forward_layer(first, m, weights, 0)
    second = _map(nodes0.select(*ROW, "s"), "x array<double>", lambda t, c: {"x": _elu(c["s"])}, ROW)
    att1, nodes1 = forward_layer(second, m, weights, 1)

    def unit(trial, c):
        y = _elu(c["s"])
        length = np.maximum(np.sqrt((y * y).sum(axis=1)), 1e-12)
        return {"s": c["s"], "z": y / length[:, None], "length": length}

    z = cut_lineage(_map(nodes1.select(*ROW, "s"), "s array<double>, z array<double>, length double", unit, ROW))
    return [(att0, nodes0), (att1, nodes1)], z


# --- loss and backward -------------------------------------------------------------------------------

def _decoder(z: DataFrame, a: DataFrame, degree: int, width: int) -> tuple[dict, DataFrame, Monomials]:
    """Loss per trial, and per node the sum over its edges of a sigmoid' z_dst.  ``a``: (src, dst, a), both directions."""
    basis = Monomials(width, degree)
    moments = moments_by(moment_sums(z, degree, by="trial", width=width), basis)
    one = z.select("trial", F.col("node").alias("src"), F.col("z").alias("zs"))
    other = z.select("trial", F.col("node").alias("dst"), F.col("z").alias("zd"), *_wide(z, "z", width, "_z"))
    sigma = 1.0 / (1.0 + F.exp(-_dot(F.col("zs"), F.col("zd"))))
    met = a.join(one, "src").join(other, ["trial", "dst"]).withColumn("sigma", sigma)
    w = F.col("a") * F.col("sigma") * (1 - F.col("sigma"))
    per = cut_lineage(met.groupBy("trial", F.col("src").alias("node")).agg(
        F.sum(F.col("a") * F.col("a") - 2 * F.col("a") * F.col("sigma")).alias("part"),
        *[F.sum(w * F.col(f"_z{k}")).alias(f"_g{k}") for k in range(width)]).select(*ROW, "part", _packed("_g", width).alias("pull")))
    parts = {r["trial"]: r["part"] for r in per.groupBy("trial").agg(F.sum("part").alias("part")).collect()}
    loss = {t: (basis.pair_sum(mu) + parts.get(t, 0.0)) / float(n) ** 2 for t, (mu, n) in moments.items()}
    return {t: (loss[t], mu, n) for t, (mu, n) in moments.items()}, per, basis


def backward_layer(att: DataFrame, nodes: DataFrame, pull: DataFrame, weights: dict[int, dict], layer: int) -> tuple[DataFrame, DataFrame]:
    """``pull``: (trial, node, ds), the loss's gradient at s.  Returns the weight gradients (trial, name, i, v) and, per
    node, the gradient at the layer's input (trial, node, dx)."""
    a_s, a_n, W = ({t: w[f"{name}{layer}"] for t, w in weights.items()} for name in ("a_self", "a_neighs", "W"))
    width = next(iter(W.values())).shape[1]
    own = cut_lineage(nodes.join(pull, ROW))

    def edge(trial, c):
        alpha = c["ex"] / c["tot"]
        de = alpha * ((c["ds"] * c["h"]).sum(axis=1) - c["c"])
        return {"alpha": alpha, "u": c["m"] * de * np.where(c["z"] >= 0, 1.0, SLOPE)}

    left = own.select("trial", F.col("node").alias("src"), "tot", "ds", _dot(F.col("ds"), F.col("s")).alias("c"))
    right = own.select("trial", F.col("node").alias("dst"), "h")
    met = att.join(left, ["trial", "src"]).join(right, ["trial", "dst"]).select(
        "trial", "src", "dst", "m", "z", "ex", "tot", "c", "ds", "h")
    back = cut_lineage(_map(met, "alpha double, u double", edge, ["trial", "src", "dst"]))
    of_source = back.groupBy("trial", F.col("src").alias("node")).agg(F.sum("u").alias("df"))
    wide = own.select("trial", F.col("node").alias("src"), *_wide(own, "ds", width, "_d"))
    of_target = back.join(wide, ["trial", "src"]).groupBy("trial", F.col("dst").alias("node")).agg(
        F.sum("u").alias("dg"), *[F.sum(F.col("alpha") * F.col(f"_d{k}")).alias(f"_r{k}") for k in range(width)])
    joined = own.select(*ROW, "x", "h").join(of_source, ROW, "left").join(of_target, ROW, "left").select(
        *ROW, "x", "h", F.coalesce("df", F.lit(0.0)).alias("df"), F.coalesce("dg", F.lit(0.0)).alias("dg"), _packed("_r", width).alias("r"))

    def whole(trial, c):
        dh = c["r"] + np.outer(c["df"], a_s[trial]) + np.outer(c["dg"], a_n[trial])
        return {"x": c["x"], "h": c["h"], "df": c["df"], "dg": c["dg"], "dh": dh, "dx": dh @ W[trial].T}

    full = cut_lineage(_map(joined, "x array<double>, h array<double>, df double, dg double, dh array<double>, dx array<double>", whole, ROW))
    return weight_gradients(full, layer), full.select(*ROW, "dx")


def weight_gradients(full: DataFrame, layer: int) -> DataFrame:
    """(trial, name, i, v): gradients of W (row by row), a_self and a_neighs, each task sending one row per cell."""
    names = ["trial", "x", "h", "df", "dg", "dh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            trials = batch.column(0).to_numpy(zero_copy_only=False)
            cols = {c: matrix(batch.column(i)) if c in ("x", "h", "dh") else batch.column(i).to_numpy(zero_copy_only=False)
                    for i, c in enumerate(names) if i}
            for t in np.unique(trials).tolist():
                c = {k: v[trials == t] for k, v in cols.items()}
                for name, part in ((f"W{layer}", c["x"].T @ c["dh"]), (f"a_self{layer}", c["df"] @ c["h"]), (f"a_neighs{layer}", c["dg"] @ c["h"])):
                    sums[t, name] = sums.get((t, name), 0.0) + part.ravel()
        for (t, name), cells in sums.items():
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.int32()), pa.array([name] * n), pa.array(range(n), pa.int32()),
                                              pa.array(cells)], names=["trial", "name", "i", "v"])

    parts = full.select(*names).mapInArrow(run, "trial int, name string, i int, v double")
    return parts.groupBy("trial", "name", "i").agg(F.sum("v").alias("v"))


def loss_and_gradients(x: DataFrame, m: DataFrame, a: DataFrame, weights: dict[int, dict], degree: int = DEGREE) -> tuple[dict, DataFrame, DataFrame]:
    """{trial: loss}, the gradients (trial, name, i, v) of all weights, and the embeddings (trial, node, z)."""
    layers, z = encode_trials(x, m, weights)
    width = next(iter(weights.values()))["W1"].shape[1]
    state, per, basis = _decoder(z, a, degree, width)
    zero = F.array(*[F.lit(0.0)] * width)
    joined = z.join(per.select(*ROW, "pull"), ROW, "left").select(*ROW, "s", "z", "length", F.coalesce("pull", zero).alias("pull"))

    def start(trial, c):
        _, mu, n = state[trial]
        dz = (2.0 * basis.gradient(c["z"], mu) - 4.0 * c["pull"]) / float(n) ** 2
        dy = (dz - c["z"] * (dz * c["z"]).sum(axis=1, keepdims=True)) / c["length"][:, None]
        return {"ds": dy * _elu_slope(c["s"])}

    ds1 = _map(joined, "ds array<double>", start, ROW)
    grads1, dx = backward_layer(*layers[1], ds1, weights, 1)
    first = dx.join(layers[0][1].select(*ROW, "s"), ROW)
    ds0 = _map(first, "ds array<double>", lambda t, c: {"ds": c["dx"] * _elu_slope(c["s"])}, ROW)
    grads0, _ = backward_layer(*layers[0], ds0, weights, 0)
    return {t: v[0] for t, v in state.items()}, cut_lineage(grads0.unionByName(grads1)), z.select(*ROW, "z")


def gradient_statistics(grads: DataFrame) -> DataFrame:
    """Per trial and weight the mean, sample deviation and length of its gradient."""
    return grads.groupBy("trial", "name").agg(F.count(F.lit(1)).alias("cells"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                              F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


# --- N15 fit, N16 search ----------------------------------------------------------------------------

@dataclass
class Trial:
    """One model: its shape, its Adam parameters, and how many epochs without a lower loss end it."""

    hidden: int
    embedding: int
    lr: float = 0.001
    weight_decay: float = 5e-3
    seed: int = 42
    patience: int | None = None
    weights: dict | None = None
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)
    steps: int = 0
    best: float = float("inf")
    waited: int = 0

    def start(self, features: int, hidden: int, embedding: int) -> None:
        """Weights from the seed, widened by zeros to the largest shape of the search (zero columns stay zero)."""
        if self.weights is None:
            self.weights = seeded_weights([features, self.hidden, self.embedding], self.seed)
        for name, value in list(self.weights.items()):
            if name not in NAMES:
                continue
            layer = int(name[-1])
            rows, cols = (features, hidden) if layer == 0 else (hidden, embedding)
            shape = (rows, cols) if name.startswith("W") else (cols,)
            wide = np.zeros(shape)
            wide[tuple(slice(0, k) for k in np.shape(value))] = value
            self.weights[name] = wide

    def step(self, grads: dict[str, np.ndarray], betas=(0.9, 0.999), eps: float = 1e-8) -> None:
        """Adam, with the decay added to the gradient."""
        self.steps += 1
        for name, g in grads.items():
            w = self.weights[name]
            g = g.reshape(w.shape) + self.weight_decay * w
            self.first[name] = betas[0] * self.first.get(name, 0.0) + (1 - betas[0]) * g
            self.second[name] = betas[1] * self.second.get(name, 0.0) + (1 - betas[1]) * g * g
            mean, square = self.first[name] / (1 - betas[0] ** self.steps), self.second[name] / (1 - betas[1] ** self.steps)
            self.weights[name] = w - self.lr * mean / (np.sqrt(square) + eps)

    def settled(self, loss: float) -> bool:
        self.waited = 0 if loss < self.best else self.waited + 1
        self.best = min(self.best, loss)
        return self.patience is not None and self.waited > self.patience


def both_directions(edges: DataFrame) -> DataFrame:
    """(src, dst, a) of undirected edges (src, dst, weight)."""
    w = F.col("weight").cast("double").alias("a")
    return edges.select("src", "dst", w).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w))


def fit_encoders(x: DataFrame, m: DataFrame, edges: DataFrame, trials: list[Trial], epochs: int, degree: int = DEGREE,
                 key: str = "author", col: str = "x"):
    """N15 and N16, one epoch at a time: yields (epoch, {trial: loss}, gradients, embeddings) of the weights *before*
    the epoch's step.  ``x``: (key, features); ``m``: transition table on the support (src, dst, m); ``edges``: (src, dst,
    weight), src < dst.  A trial whose patience is spent leaves; the weights stay in its :class:`Trial`."""
    x = cut_lineage(x.select(F.col(key).alias("node"), F.col(col).alias("x")))
    m, a = cut_lineage(m), cut_lineage(both_directions(edges))
    features = _width(x, "x")
    hidden, embedding = max(t.hidden for t in trials), max(t.embedding for t in trials)
    for t in trials:
        t.start(features, hidden, embedding)
    live = dict(enumerate(trials))
    for epoch in range(epochs):
        losses, grads, z = loss_and_gradients(x, m, a, {k: t.weights for k, t in live.items()}, degree)
        yield epoch, losses, grads, z
        cells: dict[tuple, list] = {}
        for r in grads.collect():  # as many rows as the models have weights
            cells.setdefault((r["trial"], r["name"]), []).append((r["i"], r["v"]))
        for k, t in list(live.items()):
            t.step({name: np.array([v for _, v in sorted(cells[k, name])]) for name in NAMES})
            if t.settled(losses[k]):
                del live[k]
        if not live:
            return


def pick_trials(grid: dict[str, list], count: int, seed: int = 42, **fixed) -> list[Trial]:
    """``count`` different points of the grid in a seeded order (all, if there are fewer)."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    order = sorted(points, key=lambda p: hashlib.md5(f"{seed}:{sorted(p.items())}".encode()).hexdigest())
    return [Trial(**(fixed | p)) for p in order[:count]]


def log_epochs(spark: SparkSession, states, trials: list[Trial], path: str) -> None:
    """S8 rows of a fit: one per trial and epoch with its parameters, and (``path``-gradients) one per
    trial, epoch and weight."""
    from ..sources.sinks import log_metrics
    for epoch, losses, grads, _ in states:
        log_metrics(spark, [{"epoch": epoch, "trial": k, "loss": float(v), "hidden": trials[k].hidden, "embedding": trials[k].embedding,
                             "lr": float(trials[k].lr), "weight_decay": float(trials[k].weight_decay)} for k, v in sorted(losses.items())], path)
        gradient_statistics(grads).select(F.lit(epoch).cast("long").alias("epoch"), "*").write.mode("append").parquet(f"{path}-gradients")
