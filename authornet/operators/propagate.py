"""Attention encoder and soft clustering on the edge table.

Attention is masked to the support of the normalised adjacency (edges and
self-loops), so every step is a join and a group-by on that table:
per-node scalars are joined to the edges, the softmax is a max-shifted
exponential, and one aggregate per source sums the exponentials and the
weighted neighbour vectors (a column per dimension).  Weights and cluster
centres are small, bounded inputs and travel inside the expressions.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


# --- N1 weights ------------------------------------------------------------------------

def seeded_draw(seed: int, name: str, i: int, j: int) -> float:
    """Counter-based uniform draw in [0, 1): the first 32 bits of the MD5 of
    ``seed:name:i:j``, so any engine draws the same number for a cell."""
    return int(hashlib.md5(f"{seed}:{name}:{i}:{j}".encode()).hexdigest()[:8], 16) / float(1 << 32)


def seeded_cell(seed: int, name: str, i, j, bound: float) -> Column:
    """The same draw as a column, scaled to [-bound, bound)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(i).cast("string"), F.col(j).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return (2 * u - 1) * F.lit(bound)


def weight_bounds(sizes, clusters: int | None = None) -> dict[str, tuple[int, int, float]]:
    """(rows, columns, bound) of every weight, with the reference's fans: W of shape (in, out) has
    bound sqrt(6 / in); the attention vectors (out, 1) sqrt(6 / out); centres (K, d) sqrt(6 / d)."""
    out = {}
    for li, (i, o) in enumerate(zip(sizes[:-1], sizes[1:])):
        out[f"W{li}"] = (i, o, math.sqrt(6.0 / i))
        out[f"a_self{li}"] = out[f"a_neighs{li}"] = (o, 1, math.sqrt(6.0 / o))
    if clusters:
        out["centres"] = (clusters, sizes[-1], math.sqrt(6.0 / sizes[-1]))
    return out


def seeded_weights(sizes, seed: int = 42, clusters: int | None = None) -> dict:
    """Seeded Kaiming-uniform weights, drawn cell by cell."""
    out = {}
    for name, (rows, cols, bound) in weight_bounds(sizes, clusters).items():
        cells = np.array([[(2 * seeded_draw(seed, name, i, j) - 1) * bound for j in range(cols)] for i in range(rows)])
        out[name] = cells[:, 0] if name.startswith("a_") else cells
    return out


init_weights = seeded_weights


def weight_table(x: DataFrame, name: str, cols: int, bound: float, seed: int = 42, col: str = "x") -> DataFrame:
    """N1 as a table (i, j, w) for the features of ``x``: a row per feature position that occurs, its cells drawn by Spark."""
    rows = x.select(F.explode(F.sequence(F.lit(0), F.size(col) - 1)).alias("i")).distinct()
    cells = rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"))
    return cells.select("i", "j", seeded_cell(seed, name, "i", "j", bound).alias("w"))


def rule_layers(sizes, clusters: int | None = None) -> dict:
    """The layers of :func:`init_weights` by the rule of :func:`rule_weights`,
    so that a twin can state them."""
    out = {}
    for li, (i, o) in enumerate(zip(sizes[:-1], sizes[1:])):
        out[f"W{li}"] = rule_weights(i, o)
        out[f"a_self{li}"], out[f"a_neighs{li}"] = rule_weights(o, 1)[:, 0], rule_weights(o + 1, 1)[1:, 0]
    if clusters:
        out["centres"] = rule_weights(clusters, sizes[-1])
    return out


def rule_weights(n_in: int, n_out: int) -> np.ndarray:
    """Deterministic test weights W[i, j] = ((31 i + 17 j) mod 19 - 9) / 19."""
    return np.array([[((i * 31 + j * 17) % 19 - 9) / 19.0 for j in range(n_out)] for i in range(n_in)])


# --- array helpers -----------------------------------------------------------------------

def _lit_vec(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows x length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def to_double_array(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


# --- N2-N6 encoder -----------------------------------------------------------------------------

def linear(x: DataFrame, W, key: str = "author", col: str = "x", out: str = "h") -> DataFrame:
    """h = x W with a bounded weight matrix (in x out): one literal array of
    columns and a transform, so the plan does not grow with its cells."""
    W = np.asarray(W, dtype=float)
    columns = F.array(*[_lit_vec(W[:, j]) for j in range(W.shape[1])])
    return x.select(key, F.transform(columns, lambda w: _dot(F.col(col), w)).alias(out))


def _edge_scores(h: DataFrame, m: DataFrame, a_s, a_n, slope: float, key: str) -> DataFrame:
    """(src, dst, e) over the support of ``m``: e = LeakyReLU(m * (h_src·a_s + h_dst·a_n))."""
    f = h.select(key, _dot(F.col("h"), _lit_vec(a_s)).alias("fs"), _dot(F.col("h"), _lit_vec(a_n)).alias("fn"))
    z = (m.join(f.select(F.col(key).alias("src"), "fs"), "src").join(f.select(F.col(key).alias("dst"), "fn"), "dst")
         .select("src", "dst", (F.col("m") * (F.col("fs") + F.col("fn"))).alias("z")))
    return z.select("src", "dst", F.when(F.col("z") >= 0, F.col("z")).otherwise(F.col("z") * slope).alias("e"))


def _shifted(e: DataFrame) -> DataFrame:
    """(src, dst, ex): exponentials shifted by the source's largest score."""
    mx = e.groupBy("src").agg(F.max("e").alias("mx"))
    return e.join(mx, "src").select("src", "dst", F.exp(F.col("e") - F.col("mx")).alias("ex"))


def edge_attention(h: DataFrame, m: DataFrame, a_s, a_n, slope: float = 0.05, key: str = "author") -> DataFrame:
    """α over the support (src, dst, m) of the normalised adjacency:
    softmax of the edge scores over dst per src.  ``m`` is read several
    times: pass it materialised."""
    ex = _shifted(_edge_scores(h, m, a_s, a_n, slope, key))
    tot = ex.groupBy("src").agg(F.sum("ex").alias("tot"))
    return ex.join(tot, "src").select("src", "dst", (F.col("ex") / F.col("tot")).alias("alpha"))


def _weighted_sum(w: DataFrame, weight: str, h: DataFrame, d: int, elu: bool, normalise: bool, key: str, out: str) -> DataFrame:
    """Per source, the sum of weight * h_dst: one aggregate with a column per
    dimension (and the sum of the weights), partial before its shuffle."""
    wide = h.select(F.col(key).alias("dst"), *[F.element_at("h", k + 1).alias(f"_h{k}") for k in range(d)])
    sums = w.join(wide, "dst").groupBy("src").agg(
        F.sum(weight).alias("_w"), *[F.sum(F.col(weight) * F.col(f"_h{k}")).alias(f"_s{k}") for k in range(d)])
    values = [F.col(f"_s{k}") / F.col("_w") if normalise else F.col(f"_s{k}") for k in range(d)]
    if elu:
        values = [F.when(v > 0, v).otherwise(F.exp(v) - 1) for v in values]
    return sums.select(F.col("src").alias(key), F.array(*values).alias(out))


def _width(h: DataFrame, col: str = "h") -> int:
    first = h.select(F.size(col).alias("n")).first()
    return first["n"] if first else 0


def attend(att: DataFrame, h: DataFrame, elu: bool = True, key: str = "author", out: str = "h", width: int | None = None) -> DataFrame:
    """h'_src = ELU(sum over dst of alpha * h_dst)."""
    return _weighted_sum(att, "alpha", h, width or _width(h), elu, False, key, out)


def gat_layer(x: DataFrame, m: DataFrame, W, a_s, a_n, elu: bool = True, key: str = "author",
              col: str = "x", slope: float = 0.05) -> DataFrame:
    """One attention layer.  The softmax's denominator is summed together with
    the weighted neighbours, so alpha itself is never built."""
    h = linear(x, W, key, col)
    ex = _shifted(_edge_scores(h, m, a_s, a_n, slope, key))
    return _weighted_sum(ex, "ex", h, np.asarray(W).shape[1], elu, True, key, "h")


def l2_normalize(df: DataFrame, col: str = "h", out: str = "z", key: str = "author") -> DataFrame:
    n = F.sqrt(_dot(F.col(col), F.col(col)))
    return df.select(key, F.transform(col, lambda v: v / F.greatest(n, F.lit(1e-12))).alias(out))


def encode(x: DataFrame, m: DataFrame, weights: dict, key: str = "author", col: str = "x",
           materialize: bool = True) -> DataFrame:
    """Two attention layers, L2-normalised rows -> (key, z).  The
    transition table and each layer's output are checkpointed, so every
    layer plans against stored data rather than the whole lineage."""
    if materialize:
        m = cut_lineage(m)
    h1 = gat_layer(x, m, weights["W0"], weights["a_self0"], weights["a_neighs0"], key=key, col=col)
    return encode_second(cut_lineage(h1) if materialize else h1, m, weights, key)


def encode_second(h1: DataFrame, m: DataFrame, weights: dict, key: str = "author") -> DataFrame:
    """The encoder's second layer on the (stored) first one, rows normalised."""
    h2 = gat_layer(h1.withColumnRenamed("h", "x"), m, weights["W1"], weights["a_self1"], weights["a_neighs1"], key=key)
    return l2_normalize(h2, key=key)


def score_authors(x: DataFrame, m: DataFrame, weights: dict, centres, key: str = "author", col: str = "x") -> DataFrame:
    """Encoder, a third attention layer on z, normalise, soft assignment."""
    m = cut_lineage(m)
    h1 = cut_lineage(gat_layer(x, m, weights["W0"], weights["a_self0"], weights["a_neighs0"], key=key, col=col))
    z = cut_lineage(encode_second(h1, m, weights, key))
    h3 = gat_layer(z.withColumnRenamed("z", "x"), m, weights["W2"], weights["a_self2"], weights["a_neighs2"], key=key)
    z3 = l2_normalize(h3, key=key)
    return soft_assign(z3, centres, key=key)


# --- N7/N8 decoder on given pairs ------------------------------------------------------------

def decode(z: DataFrame, pairs: DataFrame, key: str = "author", col: str = "z") -> DataFrame:
    """sigmoid(z_i · z_j) for the given (src, dst) pairs."""
    a = z.select(F.col(key).alias("src"), F.col(col).alias("zs"))
    b = z.select(F.col(key).alias("dst"), F.col(col).alias("zd"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (1.0 / (1.0 + F.exp(-_dot(F.col("zs"), F.col("zd"))))).alias("a_pred"))


# --- N9-N13 soft clustering -------------------------------------------------------------------

def soft_assign(z: DataFrame, centres, v: float = 1.0, key: str = "author", col: str = "z") -> DataFrame:
    """q_ik ∝ (1 + |z_i - mu_k|^2 / v)^(-(v + 2) / 2), rows sum to 1.
    Centres are a bounded K x d input.  Returns long (key, k, q)."""
    C = np.asarray(centres, dtype=float)
    p = -(v + 2.0) / 2.0
    raw = F.array(*[F.pow(1.0 + _sqdist(F.col(col), _lit_vec(C[k])) / v, p) for k in range(C.shape[0])])
    tot = F.aggregate(F.col("_q"), F.lit(0.0), lambda s, x: s + x)
    return (z.select(key, raw.alias("_q")).select(key, F.posexplode(F.transform("_q", lambda x: x / tot)).alias("k", "q")))


def target_distribution(q: DataFrame, key: str = "author") -> DataFrame:
    """p_ik ∝ q_ik^2 / f_k, f_k = sum_i q_ik (a K-row aggregate)."""
    f = q.groupBy("k").agg(F.sum("q").alias("f"))
    w = q.join(F.broadcast(f), "k").select(key, "k", "q", (F.col("q") * F.col("q") / F.col("f")).alias("w"))
    s = w.groupBy(key).agg(F.sum("w").alias("s"))
    return w.join(s, key).select(key, "k", (F.col("w") / F.col("s")).alias("p"))


def kl(p: DataFrame, q: DataFrame, key: str = "author") -> DataFrame:
    """KL(P || Q) averaged over rows: sum p (log p - log q) / N."""
    n = q.select(key).distinct().count()
    j = p.join(q, [key, "k"])
    return j.agg((F.sum(F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.log("q"))).otherwise(F.lit(0.0)))
                  / F.lit(float(n))).alias("kl"))


def total_loss(kl_value: float, mse: float, sil: float | None, weight: float = 2.0) -> float | None:
    """KL + MSE + weight * (1 - silhouette) / 2; null when the
    silhouette is undefined (a single cluster)."""
    if sil is None:
        return None
    return kl_value + mse + weight * (1 - sil) / 2


def hard_label(q: DataFrame, key: str = "author") -> DataFrame:
    """Arg-max over k, ties to the lowest k."""
    return q.groupBy(key).agg(F.max_by("k", F.struct(F.col("q"), -F.col("k"))).alias("cluster"))


def cluster_table(q: DataFrame, k: int, key: str = "author") -> DataFrame:
    """Hard label plus one probability column per cluster."""
    probs = q.groupBy(key).pivot("k", list(range(k))).agg(F.first("q"))
    probs = probs.select(key, *[F.col(str(i)).alias(f"cluster_{i}_prob") for i in range(k)])
    return hard_label(q, key).join(probs, key)
