"""Registered queries for the encoder's training objectives and fit (N1, N5, N6, N8, N12, N15-N17) on the author graph, the exact
nearest-neighbour join and resampling (D6, D7), the Euclidean silhouette (C1) and the neighbour embedding (C5) on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import fit as FT
from ..operators import graph as G
from ..operators import layout as LY
from ..operators import neighbours as NB
from ..operators import propagate as N
from ..operators import reconstruction as R
from ..operators import validity as V
from ..session import scratch_path
from . import sqltwin as S
from .authors import narrow_messages, round_doubles
from .catalog import register
from .q_stats import EMB_LONG, ENC, K_CENTRES, Q_SQL, X_COLS, _assign_sql, _author_x, _emb, _encoder_sql, _graph_sql, _q

SEED = 7
SIZES = [len(X_COLS), 8, 4, 4]


def _edges(spark, sf):
    return G.pair_weights(G.author_pairs(G.memberships(narrow_messages(spark, sf))))


# --- N1: seeded weights, and N5, N6 from them --------------------------------------------------------
def _cell_sql(name: str, i: str, j: str, bound: float) -> str:
    return f"(2 * (CAST(('0x' || substring(md5(concat('{SEED}:{name}:', {i}, ':', {j})), 1, 8)) AS BIGINT) / 4294967296.0) - 1) * CAST({bound!r} AS DOUBLE)"


_BOUNDS = N.weight_bounds(SIZES, K_CENTRES)


@register("n1_seeded_hidden", S.rounded(["author", "k", "h"], {"h"}, _graph_sql() + f""",
sw AS (SELECT i.i, j.j, {_cell_sql('W0', 'i.i', 'j.j', _BOUNDS['W0'][2])} AS w FROM (SELECT DISTINCT i FROM xl) i, (SELECT unnest(range({SIZES[1]})) AS j) j)
SELECT xl.author, CAST(sw.j AS INTEGER) AS k, sum(xl.x * sw.w) AS h FROM xl JOIN sw ON sw.i = xl.i GROUP BY xl.author, sw.j"""))
def q_n1(spark, sf):
    """The first layer's projection from weights that Spark draws cell by cell."""
    x, _ = _author_x(spark, sf)
    _, cols, bound = _BOUNDS["W0"]
    cells = x.select("author", F.posexplode("x").alias("i", "x")).join(N.weight_table(x, "W0", cols, bound, SEED), "i")
    return round_doubles(cells.groupBy("author", F.col("j").alias("k")).agg(F.sum(F.col("x") * F.col("w")).alias("h")))


def _seeded():
    return N.seeded_weights(SIZES, SEED, K_CENTRES)


_SEEDED = _seeded()


@register("n5_encode_seeded", S.rounded(["author", "k", "z"], {"z"}, _graph_sql() + ",\n" + _encoder_sql(_SEEDED, "xl", 2) +
                                        "\nSELECT author, CAST(i AS INTEGER) AS k, x AS z FROM y1"))
def q_n5s(spark, sf):
    x, m = _author_x(spark, sf)
    return round_doubles(N.encode(x, m, _seeded()).select("author", F.posexplode("z").alias("k", "z")))


@register("n6_score_authors_seeded", S.rounded(["author", "k", "q"], {"q"}, _graph_sql() + ",\n" + _encoder_sql(_SEEDED, "xl", 3) + ",\n" +
                                               _assign_sql("y2", _SEEDED["centres"]) + "\nSELECT author, k, q FROM sq"))
def q_n6s(spark, sf):
    x, m = _author_x(spark, sf)
    w = _seeded()
    return round_doubles(N.score_authors(x, m, w, w["centres"]))


# --- N8, N12 -----------------------------------------------------------------------------------------
_ENCODED = _graph_sql() + ",\n" + _encoder_sql(ENC, "xl", 2)
_MSE = """pd AS (SELECT a.author AS src, b.author AS dst, sum(a.x * b.x) AS t FROM y1 a JOIN y1 b ON a.i = b.i GROUP BY a.author, b.author),
re AS (SELECT count(DISTINCT pd.src) AS nodes, avg(pow(1 / (1 + exp(-pd.t)) - coalesce(s.weight, 0), 2)) AS mse FROM pd LEFT JOIN sym s ON s.src = pd.src AND s.dst = pd.dst)"""


@register("n8_reconstruction_loss", S.rounded(["nodes", "mse"], {"mse"}, _ENCODED + ",\n" + _MSE + "\nSELECT CAST(nodes AS BIGINT) AS nodes, mse FROM re"))
def q_n8(spark, sf):
    """N8 over all cells (the twin sums every pair of authors)."""
    x, m = _author_x(spark, sf)
    return round_doubles(R.reconstruction_loss(N.encode(x, m, ENC), _edges(spark, sf)).select("nodes", "mse"))


@register("n12_total_loss", S.rounded(["kl", "mse", "silhouette", "clusters", "total"], {"kl", "mse", "silhouette", "total"}, _ENCODED + ",\n" + _MSE + ",\n" +
                                      _assign_sql("y1", ENC["centres"]) + f""",
fk AS (SELECT k, sum(q) AS f FROM sq GROUP BY k),
pk AS (SELECT s.author, s.k, s.q, s.q * s.q / fk.f / sum(s.q * s.q / fk.f) OVER (PARTITION BY s.author) AS p FROM sq s JOIN fk ON fk.k = s.k),
kl AS (SELECT sum(p * (ln(p) - ln(q))) / count(DISTINCT author) AS kl FROM pk),
hd AS (SELECT author, k AS cluster FROM (SELECT author, k, row_number() OVER (PARTITION BY author ORDER BY q DESC, k) AS rn FROM sq) t WHERE rn = 1),
cs AS (SELECT cluster, count(*) AS n FROM hd GROUP BY cluster),
dd AS (SELECT a.author, h.cluster, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM y1 a JOIN y1 b ON a.i = b.i JOIN hd h ON h.author = b.author GROUP BY a.author, h.cluster),
ab AS (SELECT dd.author, max(dd.d2 / greatest(cs.n - 1, 1)) FILTER (WHERE dd.cluster = h.cluster) AS a, min(dd.d2 / cs.n) FILTER (WHERE dd.cluster <> h.cluster) AS b,
         max(cs.n) FILTER (WHERE dd.cluster = h.cluster) AS n FROM dd JOIN hd h ON h.author = dd.author JOIN cs ON cs.cluster = dd.cluster GROUP BY dd.author),
si AS (SELECT avg(CASE WHEN b IS NULL THEN NULL WHEN n <= 1 THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM ab)
SELECT kl.kl, re.mse, si.silhouette, (SELECT CAST(count(*) AS BIGINT) FROM cs) AS clusters,
  CASE WHEN (SELECT count(*) FROM cs) > 1 THEN kl.kl + re.mse + 2 * (1 - si.silhouette) / 2 END AS total FROM kl, re, si"""))
def q_n12(spark, sf):
    """KL, N8 and C1 of one state of the encoder in one row."""
    from ..session import cut_lineage
    x, m = _author_x(spark, sf)
    z = cut_lineage(N.encode(x, m, ENC))
    q = cut_lineage(N.soft_assign(z, ENC["centres"]))
    return round_doubles(R.total_loss(z, _edges(spark, sf), q, N.hard_label(q)))


# --- N15-N17 -----------------------------------------------------------------------------------------
FIT_EPOCHS, GRID = 3, {"hidden": [4, 8], "embedding": [2, 3], "lr": [0.01, 0.05], "weight_decay": [1e-4, 5e-3]}


def _standard(x):
    """Features with mean 0 and deviation 1 (constant ones 0), as array column x."""
    cells = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    mean, dev = (F.array(*[F.lit(float(r[c]) if c == "m" else float(r[c]) or 1.0) for r in cells]) for c in ("m", "s"))
    return x.select("author", F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), dev, lambda a, b: a / b).alias("x"))


def _fit(spark, sf, trials, epochs):
    x, m = _author_x(spark, sf)
    path = scratch_path(spark, "fit")
    FT.log_epochs(spark, FT.fit_encoders(_standard(x), m, _edges(spark, sf), trials, epochs, degree=9), trials, path)
    return spark.read.parquet(path), spark.read.parquet(f"{path}-gradients")


@register("n15_fit_encoder")
def q_n15(spark, sf):
    """The loss before each epoch's step of one encoder (8 hidden, 4 dimensions), logged through S8."""
    log, _ = _fit(spark, sf, [FT.Trial(hidden=8, embedding=4, lr=0.05, seed=SEED)], FIT_EPOCHS + 1)
    return round_doubles(log.select("epoch", "trial", "loss"))


@register("n16_random_search")
def q_n16(spark, sf):
    """Four points of the grid fitted side by side; a row per trial and epoch."""
    log, _ = _fit(spark, sf, FT.pick_trials(GRID, 4, SEED, patience=1), FIT_EPOCHS)
    return round_doubles(log.select("trial", "epoch", "hidden", "embedding", "lr", "weight_decay", "loss"))


@register("n17_gradient_statistics")
def q_n17(spark, sf):
    """Mean, deviation and length of every weight's gradient per epoch."""
    _, grads = _fit(spark, sf, [FT.Trial(hidden=8, embedding=4, lr=0.05, seed=SEED)], FIT_EPOCHS)
    return grads.select("epoch", "trial", "name", "cells", "mean", "std", "norm")


TRAINED = FT.Trial(hidden=16, embedding=9, lr=0.02, weight_decay=1e-4, seed=SEED)


def trained_authors(spark, sf, epochs: int = 4, k: int = K_CENTRES):
    """Clusters of the authors from an encoder that is fitted to their graph: 30 standard features, ``epochs`` steps,
    centres by k-means on the embeddings, soft assignment."""
    from dataclasses import replace

    from ..operators import clean as C
    from ..session import cut_lineage
    from .authors import author_table
    feats = cut_lineage(author_table(spark, sf))
    x = _standard(C.assemble(C.fill_zero(feats, A.FEATURES_30), A.FEATURES_30, keep=["author"]))
    mem = G.memberships(narrow_messages(spark, sf))
    edges = cut_lineage(G.pair_weights(G.author_pairs(mem)))
    m = cut_lineage(G.transition(edges, mem, t=2))
    trial = replace(TRAINED, first={}, second={})
    losses = [loss[0] for _, loss, _, _ in FT.fit_encoders(x, m, edges, [trial], epochs, degree=5)]
    _, z = FT.encode_trials(x.withColumnRenamed("author", "node"), m, {0: trial.weights})
    z = cut_lineage(z.select(F.col("node").alias("author"), "z"))
    return N.cluster_table(N.soft_assign(z, V.start_centres(z, k)), k), losses


@register("n13_trained_authors")
def q_n13t(spark, sf):
    """N13 from a fitted encoder instead of given weights."""
    return round_doubles(trained_authors(spark, sf)[0])


@register("c5_neighbour_layout")
def q_c5n(spark, sf):
    """Neighbour embedding of the vectors in two dimensions."""
    return round_doubles(LY.neighbour_layout(_emb(spark, sf)))


# --- C1 Euclidean, D6, D7 ------------------------------------------------------------------------------
def _sliced_sql() -> str:
    u = V.projections(64, V.SLICES)
    rows = ", ".join(f"({r}, {d}, {float(u[r, d])!r})" for r in range(u.shape[0]) for d in range(u.shape[1]))
    return S.with_ctes(EMB_LONG) + f""",
pj AS (SELECT e.vec_id, e.label, u.r, sum(e.v * u.u) AS p FROM emb e JOIN (VALUES {rows}) u(r, d, u) ON u.d = e.d GROUP BY e.vec_id, e.label, u.r),
tt AS (SELECT a.vec_id, a.label, b.label AS cluster, sum(abs(a.p - b.p)) AS t FROM pj a JOIN pj b ON a.r = b.r GROUP BY a.vec_id, a.label, b.label),
cs AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
ab AS (SELECT tt.vec_id, max(tt.t / greatest(cs.n - 1, 1)) FILTER (WHERE tt.cluster = tt.label) AS a, min(tt.t / cs.n) FILTER (WHERE tt.cluster <> tt.label) AS b,
         max(cs.n) FILTER (WHERE tt.cluster = tt.label) AS n FROM tt JOIN cs ON cs.label = tt.cluster GROUP BY tt.vec_id)
SELECT avg(CASE WHEN b IS NULL THEN NULL WHEN n <= 1 THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM ab"""


@register("c1_silhouette_sliced", S.rounded(["silhouette"], {"silhouette"}, _sliced_sql()))
def q_c1s(spark, sf):
    """C1 with Euclidean distance, from sliced distances (the twin sums all pairs of each direction)."""
    return round_doubles(V.silhouette_sliced(_emb(spark, sf)).select("silhouette"))


def _near_sql(k: int, same: bool = False) -> str:
    """nn (a, b, nth, distance, la, lb): the k nearest rows of each row of ``src`` (key, label, e)."""
    on = "a.key <> b.key" + (" AND a.label = b.label" if same else "")
    return f"""nn AS (SELECT * FROM (SELECT a.key AS a, b.key AS b, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS distance,
  row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.e, b.e), b.key) AS nth FROM src a JOIN src b ON {on}) t WHERE nth <= {k})"""


_VECTORS = "SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e"


@register("d7_nearest_neighbours", S.rounded(["key", "nth", "neighbour", "distance"], {"distance"}, f"WITH src AS ({_VECTORS}, label FROM embeddings),\n" +
                                             _near_sql(5) + "\nSELECT a AS key, CAST(nth AS INTEGER) AS nth, b AS neighbour, distance FROM nn"))
def q_d7n(spark, sf):
    """Exact 5 nearest rows of every vector."""
    near, _ = NB.nearest(_emb(spark, sf), "vec_id", "embedding", 5, pivots=16, block=64)
    return round_doubles(near)


def _classed(spark, sf):
    """Vectors with the parity of their nearest centre as class, so that neighbours tend to agree."""
    hard = N.hard_label(_q(spark, sf), key="vec_id").withColumn("cluster", (F.col("cluster") % 2).cast("int"))
    return _emb(spark, sf).select("vec_id", "embedding").join(hard, "vec_id")


_CLASSED = Q_SQL + f", src AS ({_VECTORS.replace('vec_id', 'm.vec_id')}, CAST(h.cluster % 2 AS INTEGER) AS label FROM embeddings m JOIN hard h ON h.vec_id = m.vec_id),\n"


@register("d7_edited_neighbours", _CLASSED + _near_sql(3) + """,
vt AS (SELECT a, la, lb, count(*) AS n FROM nn GROUP BY a, la, lb),
mo AS (SELECT a, lb FROM (SELECT a, lb, row_number() OVER (PARTITION BY a ORDER BY n DESC, lb) AS r FROM vt) t WHERE r = 1)
SELECT nn.a AS key, nn.la AS label, CAST(count(*) FILTER (WHERE nn.la = nn.lb) AS BIGINT) AS agree, bool_and(nn.la = nn.lb) AS kept, bool_and(mo.lb = nn.la) AS kept_by_most
FROM nn JOIN mo ON mo.a = nn.a GROUP BY nn.a, nn.la""")
def q_d7(spark, sf):
    """Which rows the edited nearest neighbours keep."""
    return NB.edited(_classed(spark, sf), "vec_id", "embedding", "cluster", pivots=16, block=64)


def _draw_sql(name: str) -> str:
    return f"(CAST(('0x' || substring(md5(concat('42:{name}:', d.key, ':', d.nth)), 1, 8)) AS BIGINT) / 4294967296.0)"


@register("d6_smote", S.rounded(["base", "nth", "label", "neighbour", "gap", "d", "value"], {"gap", "value"}, _CLASSED + _near_sql(5, same=True) + f""",
sz AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS m FROM src GROUP BY label),
rk AS (SELECT s.key, s.label, sz.n, sz.m - sz.n AS need, row_number() OVER (PARTITION BY s.label ORDER BY s.key) - 1 AS r FROM src s JOIN sz ON sz.label = s.label),
d AS (SELECT key, label, unnest(range(CAST(need // n + CASE WHEN r < need % n THEN 1 ELSE 0 END AS BIGINT))) AS nth FROM rk),
av AS (SELECT a, count(*) AS k FROM nn GROUP BY a),
dr AS (SELECT d.*, {_draw_sql('gap')} AS gap, CAST(floor({_draw_sql('neighbour')} * av.k) + 1 AS BIGINT) AS pick FROM d JOIN av ON av.a = d.key),
mx AS (SELECT dr.key AS base, dr.nth, dr.label, nn.b AS neighbour, dr.gap, x.e AS xb, y.e AS xn FROM dr JOIN nn ON nn.a = dr.key AND nn.nth = dr.pick
  JOIN src x ON x.key = dr.key JOIN src y ON y.key = nn.b),
ex AS (SELECT *, unnest(range(64)) AS d FROM mx)
SELECT base, nth, label, neighbour, gap, CAST(d AS INTEGER) AS d, xb[d + 1] + gap * (xn[d + 1] - xb[d + 1]) AS value FROM ex"""))
def q_d6(spark, sf):
    """Synthetic rows of the smaller class, a row per dimension."""
    made = NB.smote(_classed(spark, sf), "vec_id", "embedding", "cluster", pivots=16, block=64)
    return round_doubles(made.select("base", "nth", "label", "neighbour", "gap", F.posexplode("x").alias("d", "value")))
