"""Cluster validity (C1-C5) and centre refinement.

Everything reduces to per-cluster sufficient statistics (count, vector sum,
sum of squared norms) - a K-row table - which is joined to the points or,
where a point meets all clusters, to one row that holds them as an array; the cost is
linear in the points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .propagate import _dot, _lit_vec, _sqdist, _width, matrix, seeded_draw, to_double_array

# Clusters whose K x d statistics travel as one row; more of them travel as several rows.
MAX_CLUSTERS = 1_000
# Directions of the sliced silhouette, and the groups that tell its error.
SLICES, SLICE_GROUPS = 64, 8


def cluster_stats(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(label, n, s, q): size, vector sum and sum of squared norms of each
    cluster, from one aggregation over the long form with partial sums."""
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(to_double_array(x)).alias("d", "v"))
    per = long.groupBy("label", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
                                         F.count(F.lit(1)).alias("n"))
    by_d = F.array_sort(F.collect_list(F.struct("d", "s")))  # one entry per dimension
    return per.groupBy("label").agg(F.max("n").alias("n"), F.transform(by_d, lambda r: r["s"]).alias("s"), F.sum("q").alias("q"))


def _in_rows(stats: DataFrame, *cols) -> tuple[DataFrame, int]:
    """All clusters as arrays ``all`` of at most about MAX_CLUSTERS each, keyed by ``_one`` = 0 .. their number - 1;
    few clusters are one row."""
    n = -(-stats.count() // MAX_CLUSTERS) or 1
    part = F.pmod(F.xxhash64("label"), F.lit(n)).cast("long").alias("_one")
    return stats.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all")), n


def _every_row(col, n: int) -> Column:
    """Numbers 0 .. n - 1 (see :func:`_zero`): a point meets each of the rows of clusters."""
    return F.explode(F.sequence(_zero(col), _zero(col) + F.lit(n - 1)))


def _zero(col) -> Column:
    """0 for every row, but from the row's data: the one row of clusters then meets the
    points in a hash join (a literal key would be folded away and leave no key at all)."""
    return F.pmod(F.xxhash64(col), F.lit(1))


def labels_used(df: DataFrame, label: str = "label") -> DataFrame:
    """C4."""
    return df.agg(F.countDistinct(label).cast("bigint").alias("labels_used"))


def silhouette_sq(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """C1 (linear-cost form): silhouette with squared Euclidean distance,
    the metric Spark's ClusteringEvaluator supports.  Mean squared distance
    of a point to cluster C is |x|^2 - 2 x·S_C/n_C + Q_C/n_C; a uses
    n_A - 1 (the point itself excluded); singletons score 0.  Returns the
    per-point scores; average them for the index."""
    rows, parts = _in_rows(cluster_stats(df, x, label, key), "label", "n", "s", "q")
    nx = _dot(F.col("_x"), F.col("_x"))
    total = lambda c: nx * c["n"] - 2 * _dot(F.col("_x"), c["s"]) + c["q"]
    own = F.get(F.filter("all", lambda c: c["label"] == F.col("_l")), F.lit(0))
    rest = F.transform(F.filter("all", lambda c: c["label"] != F.col("_l")), lambda c: total(c) / c["n"])
    points = df.select(key, F.col(label).alias("_l"), to_double_array(x).alias("_x"), _every_row(key, parts).alias("_one"))
    ab = points.join(F.broadcast(rows), "_one").select(  # at most MAX_CLUSTERS x d values a row
        key, (F.try_divide(total(own), F.greatest(own["n"] - 1, F.lit(1)))).alias("_a"), F.array_min(rest).alias("_b"), own["n"].alias("_n"))
    if parts > 1:
        ab = ab.groupBy(key).agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"), F.max("_n").alias("_n"))
    a, b = F.col("_a"), F.col("_b")
    s = F.when(b.isNull(), F.lit(None).cast("double")).when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0)))
    return ab.select(key, s.alias("silhouette"))


def silhouette(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """C1 index (mean of the per-point squared-distance silhouettes)."""
    return silhouette_sq(df, x, label, key).agg(F.avg("silhouette").alias("silhouette"))


def projections(d: int, count: int, seed: int = 42) -> np.ndarray:
    """``count`` unit directions in d dimensions from counter-based normal draws (Box-Muller), made orthogonal in blocks of d:
    a whole block shows every length alike, so the estimates vary less."""
    u = np.array([[seeded_draw(seed, "direction", r, j) for j in range(2 * d)] for r in range(count)])
    normal = np.sqrt(-2 * np.log1p(-u[:, :d])) * np.cos(2 * np.pi * u[:, d:])
    return np.concatenate([np.linalg.qr(normal[at:at + d].T)[0].T for at in range(0, count, d)])


def _sliced(df: DataFrame, x: str, label: str, key: str, slices: int, seed: int) -> tuple[DataFrame, list, np.ndarray]:
    """(key, label, slice, totals), the clusters that ``totals`` lists in order, and their sizes.
    The projections are sorted by (direction, value); running counts and sums per cluster give every sum, and each task
    starts from what lies before it.  Linear in points x slices x clusters."""
    points = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(x).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).alias("label"), to_double_array(x).alias("x"))
    u = projections(_width(points, "x") or 1, slices, seed)
    kind = {c: points.schema[c].dataType.simpleString() for c in ("key", "label")}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2)) @ u.T if b.num_rows else np.zeros((0, slices))
            at = pa.array(np.repeat(np.arange(b.num_rows), slices))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at),
                                              pa.array(np.tile(np.arange(slices, dtype=np.int32), b.num_rows)), pa.array(v.ravel())],
                                             names=["key", "label", "slice", "v"])

    flat = points.mapInArrow(project, f"key {kind['key']}, label {kind['label']}, slice int, v double")
    placed = cut_lineage(flat.repartitionByRange("slice", "v", "key").sortWithinPartitions("slice", "v", "key")
                         .withColumn("part", F.spark_partition_id()))
    # (tasks + slices) x clusters rows: what each task holds of a slice
    held = placed.groupBy("slice", "part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).orderBy("slice", "part").collect()
    clusters = sorted({r["label"] for r in held})
    number = {c: i for i, c in enumerate(clusters)}
    whole, starts = np.zeros((slices, 2, len(clusters))), {}
    for (sl, part), rows in itertools.groupby(held, key=lambda r: (r["slice"], r["part"])):
        starts[part, sl] = whole[sl].copy()
        for r in rows:
            whole[sl, :, number[r["label"]]] += (r["n"], r["s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                rows = b.slice(lo, 4096)
                cut, v = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                member = np.eye(len(clusters))[[number[c] for c in rows.column(1).to_pylist()]]
                total = np.zeros_like(member)
                for sl in np.unique(cut).tolist():
                    here = cut == sl
                    if sl not in state:
                        state[sl] = starts[rows.column(4)[int(np.argmax(here))].as_py(), sl].copy()
                    n = state[sl][0] + np.cumsum(member[here], axis=0)
                    s = state[sl][1] + np.cumsum(member[here] * v[here, None], axis=0)
                    w = v[here, None]
                    total[here] = w * n - s + (whole[sl, 1] - s) - w * (whole[sl, 0] - n)
                    state[sl] = np.stack([n[-1], s[-1]])
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), len(clusters)).cast(
                    pa.list_(pa.float64()))], names=["key", "label", "slice", "totals"])

    if not clusters:
        return placed.select("key", "label", "slice", F.array(F.col("v")).alias("totals")), [], np.zeros(0)
    out = placed.select("key", "label", "slice", "v", "part").mapInArrow(
        sums, f"key {kind['key']}, label {kind['label']}, slice int, totals array<double>")
    return out, clusters, whole[0, 0]


def sliced_totals(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id", slices: int = SLICES,
                  seed: int = 42) -> DataFrame:
    """(key, label, slice, cluster, total): for each direction the exact sum of |u . (x - y)| over the members y of each cluster."""
    out, clusters, _ = _sliced(df, x, label, key, slices, seed)
    kind = out.schema["label"].dataType.simpleString()
    names = out.sparkSession.createDataFrame(list(enumerate(clusters)), f"pos int, cluster {kind}")
    return out.select("key", "label", "slice", F.posexplode("totals").alias("pos", "total")).join(names, "pos").drop("pos")


def _scores(key: np.ndarray, own: np.ndarray, total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes of the points numbered in ``key`` (ascending from 0) from their summed distances to each cluster;
    NaN where there is no other cluster.  Scale and number of slices cancel in every score.  A key given with
    several clusters takes the largest distance to its own and the smallest to another."""
    at = np.arange(len(key))
    mean = total / sizes
    inside = total[at, own] / np.maximum(sizes[own] - 1, 1)
    mean[at, own] = np.inf
    first = np.flatnonzero(np.diff(key, prepend=-1))
    a, b = np.maximum.reduceat(inside, first), np.minimum.reduceat(mean.min(axis=1), first)
    top = np.maximum(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where(top > 0, (b - a) / top, 0.0)
    s[np.maximum.reduceat(sizes[own], first) <= 1] = 0.0
    s[np.isinf(b)] = np.nan
    return s


def silhouette_sliced(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id", slices: int = SLICES,
                      seed: int = 42) -> DataFrame:
    """C1 with Euclidean distance: one row (silhouette, error).  The mean distance from a point to a cluster is estimated from
    ``slices`` directions, each exact, up to a factor common to all distances.  ``error``: two standard errors
    over the indices of ``SLICE_GROUPS`` groups of directions, and the index's own distance from their mean.
    A point's distances to all clusters stay one array, and its rows meet once, sorted by key: no table of
    points x clusters is joined or sent to the driver."""
    totals, clusters, sizes = _sliced(df, x, label, key, slices, seed)
    number = {c: i for i, c in enumerate(clusters)}
    groups = min(slices, SLICE_GROUPS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(groups + 1), np.zeros(groups + 1, dtype=np.int64)

        def take(rows: pa.Table) -> None:
            names = rows.column("key").combine_chunks().dictionary_encode()
            k = names.indices.to_numpy()  # equal keys lie together, so these ascend
            own = np.array([number[c] for c in rows.column("label").to_pylist()])
            g = rows.column("slice").to_numpy() % SLICE_GROUPS
            total = matrix(rows.column("totals"))
            unit, point = np.unique(k.astype(np.int64) * len(clusters) + own, return_inverse=True)
            each = np.zeros((groups, len(unit), len(clusters)))
            np.add.at(each, (g, point), total)
            for at, t in [*enumerate(each), (groups, each.sum(axis=0))]:
                s = _scores(unit // len(clusters), unit % len(clusters), t, sizes)
                sums[at] += np.nansum(s)
                counts[at] += int((~np.isnan(s)).sum())

        kept = None  # the last key's rows so far
        for b in batches:
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            k = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.argmax(k == k[-1]))
            if last:
                take(rows.slice(0, last))
            kept = rows.slice(last)
        if kept is not None:
            take(kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups + 1, dtype=np.int32)), pa.array(sums), pa.array(counts)], names=["g", "s", "n"])

    by_key = totals.repartition("key").sortWithinPartitions("key", "slice")
    found = by_key.mapInArrow(score, "g int, s double, n bigint") if clusters else totals.select(
        F.col("slice").alias("g"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    index = found.groupBy("g").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("s"))  # a row per group and one for all
    part = F.when(F.col("g") < groups, F.col("s"))
    one = index.agg(F.max(F.when(F.col("g") == groups, F.col("s"))).alias("s"), F.avg(part).alias("m"),
                    (2 * F.stddev_samp(part) / math.sqrt(groups)).alias("e"))
    return one.select(F.col("s").alias("silhouette"), (F.col("e") + F.abs(F.col("s") - F.col("m"))).alias("error"))


def calinski_harabasz(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(B / (K - 1)) / (W / (n - K)).  W = sum of |x|^2 - sum_k |S_k|^2 / n_k,
    B = sum_k |S_k|^2 / n_k - |S|^2 / n, both from the cluster statistics."""
    stats = cluster_stats(df, x, label, key)
    sums = stats.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("q").alias("q"),
                     F.sum(_dot(F.col("s"), F.col("s")) / F.col("n")).alias("c"))
    total = stats.select(F.posexplode("s").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("v"))
    grand = total.agg(F.sum(F.col("v") * F.col("v")).alias("t"))
    n, k, q, c = sums.first()
    t = grand.first()[0]  # scalars
    within = (q or 0.0) - (c or 0.0)
    value = float(((c - t / n) / (k - 1)) / (within / (n - k))) if k > 1 and within > 0 else None
    return df.sparkSession.createDataFrame([(value,)], "calinski_harabasz double")


def davies_bouldin(df: DataFrame, x: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j), s = mean
    Euclidean distance of members to their centroid (the points joined with
    their centroid); every centroid then meets the rows that hold all centroids."""
    stats = cluster_stats(df, x, label, key).select("label", F.transform("s", lambda v: v / F.col("n")).alias("c"))
    points = df.select(F.col(label).alias("label"), to_double_array(x).alias("_x"))
    spread = points.join(stats, "label").groupBy("label").agg(F.avg(F.sqrt(_sqdist(F.col("_x"), F.col("c")))).alias("s"))
    each = stats.join(spread, "label")
    rows, parts = _in_rows(each, "label", "c", "s")
    one = each.select(F.struct("label", "c", "s").alias("i"), _every_row("label", parts).alias("_one")).join(F.broadcast(rows), "_one")
    ratios = F.transform(F.filter("all", lambda j: j["label"] != F.col("i.label")),
                         lambda j: (F.col("i.s") + j["s"]) / F.nullif(F.sqrt(_sqdist(F.col("i.c"), j["c"])), F.lit(0.0)))
    worst = F.array_max(F.transform(ratios, lambda r: F.coalesce(r, F.lit(math.inf))))
    per = one.select(F.col("i.label").alias("label"), worst.alias("r")).groupBy("label").agg(F.max("r").alias("r"))
    return per.agg(F.avg("r").alias("davies_bouldin"))


def project_2d(df: DataFrame, x: str = "embedding", key: str = "vec_id") -> DataFrame:
    """2-D projection with Spark ML PCA (re-aimed from t-SNE)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    vec = df.select(key, array_to_vector(to_double_array(x)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vec)
    out = model.transform(vec).select(key, vector_to_array("pc").alias("pc"))
    return out.select(key, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def start_centres(z: DataFrame, k: int, seed: int = 42, x: str = "z") -> np.ndarray:
    """k-means centres (Spark ML) to start the refinement from."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    vec = z.select(array_to_vector(to_double_array(x)).alias("features"))
    return np.array([c for c in KMeans(k=k, seed=seed, featuresCol="features").fit(vec).clusterCenters()])


def refine_epochs(z: DataFrame, centres: np.ndarray, epochs: int = 10, lr: float = 0.01,
                  x: str = "z", key: str = "author", v: float = 1.0):
    """N14, one epoch at a time: yields (epoch, centres, q) of the centres
    *before* the epoch's step, then takes a full-batch gradient step on KL(P || Q) with z
    fixed, and at last yields the final state.  A step is one distributed
    pass that sums the K x d gradient; only that leaves the cluster."""
    from .propagate import soft_assign, target_distribution
    C = np.array(centres, dtype=float)
    zz = z.select(key, to_double_array(x).alias("z"))
    coef = (v + 2.0) / v
    n = zz.count()
    for epoch in range(epochs + 1):
        q = soft_assign(zz, C, v=v, key=key)
        yield epoch, C, q
        if epoch == epochs:
            return
        p = target_distribution(q, key)
        # dKL/dmu_k = -(v+2)/v * sum_i (p_ik - q_ik) (z_i - mu_k) / (1 + |z_i - mu_k|^2 / v);
        # one pass: each (point, k) row contributes its weighted difference,
        # summed per (k, dimension) - a K x d result.
        mus = F.array(*[_lit_vec(c) for c in C])
        j = p.join(q, [key, "k"]).join(zz, key).withColumn("mu", F.element_at(mus, F.col("k") + 1))
        wgt = (F.col("p") - F.col("q")) / (1.0 + _sqdist(F.col("z"), F.col("mu")) / v)
        contrib = j.select("k", F.posexplode(F.zip_with("z", "mu", lambda a, b: (a - b) * wgt)).alias("d", "g"))
        G = np.zeros_like(C)
        for r in contrib.groupBy("k", "d").agg(F.sum("g").alias("g")).collect():  # K x d rows
            G[r["k"], r["d"]] = r["g"]
        C = C + lr * coef * G / max(n, 1)


def refine_centres(z: DataFrame, k: int, epochs: int = 10, lr: float = 0.01, seed: int = 42,
                   x: str = "z", key: str = "author", v: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Centres after ``epochs`` steps from ``start`` (k-means when not given)."""
    centres = start_centres(z, k, seed, x) if start is None else start
    for _, centres, _ in refine_epochs(z, centres, epochs, lr, x, key, v):
        pass
    return centres
