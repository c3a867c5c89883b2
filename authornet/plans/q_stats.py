"""Registered queries for clustering, validity and statistics (A13-A17, J8,
C1-C5, D1-D5, D10-D14, W2-W6, N2-N4, N7, N9-N14, S6).

Embeddings and labels come from ``embeddings`` (unit vectors, 10 labels);
centres for the soft assignment are the means of all vectors with the same
``label % 6``;
label / prediction pairs for the classification metrics come from
``labels`` (quality as truth, toxic as prediction); numeric columns for
descriptive statistics come from ``events`` and ``documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import propagate as N
from ..operators import stats as ST
from ..operators import validity as V
from ..sources.tables import table
from . import sqltwin as S
from .authors import clean_messages, narrow_messages, round_doubles
from .catalog import register

K_CENTRES = 6
EMB_LONG = """emb AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
                     unnest(range(len(embedding))) AS d FROM embeddings)"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _centres(spark, sf):
    """K x d centres (bounded K): means over the whole table."""
    long = _emb(spark, sf).select((F.col("label") % K_CENTRES).cast("int").alias("k"),
                                  F.posexplode(N.to_double_array("embedding")).alias("d", "v"))
    cells = {(r["k"], r["d"]): r["v"] for r in long.groupBy("k", "d").agg(F.avg("v").alias("v")).collect()}  # K x d
    out = np.zeros((K_CENTRES, 1 + max(d for _, d in cells)))
    for at, v in cells.items():
        out[at] = v
    return out


def _q(spark, sf):
    z = _emb(spark, sf).select("vec_id", N.to_double_array("embedding").alias("z"))
    return N.soft_assign(z, _centres(spark, sf), key="vec_id")


Q_SQL = S.with_ctes(EMB_LONG) + f""",
cen AS (SELECT label % {K_CENTRES} AS k, d, avg(v) AS v FROM emb GROUP BY label % {K_CENTRES}, d),
dist AS (SELECT e.vec_id, c.k, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM emb e JOIN cen c ON e.d = c.d GROUP BY e.vec_id, c.k),
qr AS (SELECT vec_id, k, pow(1.0 + d2, -1.5) AS w FROM dist),
q AS (SELECT vec_id, CAST(k AS INTEGER) AS k, w / sum(w) OVER (PARTITION BY vec_id) AS q FROM qr),
f AS (SELECT k, sum(q) AS f FROM q GROUP BY k),
pw AS (SELECT q.vec_id, q.k, q.q * q.q / f.f AS w FROM q JOIN f ON q.k = f.k),
p AS (SELECT vec_id, k, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM pw),
hard AS (SELECT vec_id, k AS cluster FROM (
           SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, k ASC) AS rn FROM q) t
         WHERE rn = 1)
"""


@register("n9_soft_assign", S.rounded(["vec_id", "k", "q"], {"q"}, Q_SQL + "SELECT vec_id, k, q FROM q"))
def q_n9(spark, sf):
    return round_doubles(_q(spark, sf))


@register("n10_target_distribution", S.rounded(["vec_id", "k", "p"], {"p"}, Q_SQL + "SELECT vec_id, k, p FROM p"))
def q_n10(spark, sf):
    return round_doubles(N.target_distribution(_q(spark, sf), key="vec_id"))


@register("n11_kl", S.rounded(["kl"], {"kl"}, Q_SQL + "SELECT sum(p.p * (ln(p.p) - ln(q.q))) / (SELECT count(DISTINCT vec_id) FROM q) AS kl FROM p JOIN q ON p.vec_id = q.vec_id AND p.k = q.k"))
def q_n11(spark, sf):
    q = _q(spark, sf)
    return round_doubles(N.kl(N.target_distribution(q, key="vec_id"), q, key="vec_id"))


@register("w4_hard_label", Q_SQL + "SELECT vec_id, cluster FROM hard")
def q_w4(spark, sf):
    return N.hard_label(_q(spark, sf), key="vec_id")


_PROB = [f"cluster_{i}_prob" for i in range(K_CENTRES)]


@register("n13_cluster_table", S.rounded(["vec_id", "cluster"] + _PROB, set(_PROB), Q_SQL + "SELECT h.vec_id, h.cluster, " +
          ", ".join(f"max(q.q) FILTER (WHERE q.k = {i}) AS cluster_{i}_prob" for i in range(K_CENTRES)) +
          " FROM hard h JOIN q ON q.vec_id = h.vec_id GROUP BY h.vec_id, h.cluster"))
def q_n13(spark, sf):
    return round_doubles(N.cluster_table(_q(spark, sf), K_CENTRES, key="vec_id"))


@register("s6_cluster_labels", Q_SQL + "SELECT vec_id, cluster FROM hard")
def q_s6(spark, sf):
    from ..sources.sinks import cluster_labels
    return cluster_labels(N.hard_label(_q(spark, sf), key="vec_id"), key="vec_id")


@register("a13_cluster_sizes", "SELECT label, CAST(count(*) AS BIGINT) AS size FROM embeddings GROUP BY label")
def q_a13(spark, sf):
    return ST.cluster_sizes(_emb(spark, sf), "label")


@register("a14_cluster_means", S.rounded(["label", "d", "mean"], {"mean"}, S.with_ctes(EMB_LONG) +
                                         "SELECT label, CAST(d AS INTEGER) AS d, avg(v) AS mean FROM emb GROUP BY label, d"))
def q_a14(spark, sf):
    long = _emb(spark, sf).select("label", F.posexplode(N.to_double_array("embedding")).alias("d", "v"))
    return round_doubles(ST.cluster_means(long, ["v"], label=["label", "d"]).withColumnRenamed("v", "mean"))


@register("j8_means_with_counts", S.rounded(["event_type", "value", "size"], {"value"},
                                            "SELECT event_type, avg(value) AS value, CAST(count(*) AS BIGINT) AS size FROM events GROUP BY event_type"))
def q_j8(spark, sf):
    return round_doubles(ST.means_with_counts(table(spark, sf, "events"), ["value"], by="event_type"))


@register("c4_labels_used", "SELECT CAST(count(DISTINCT label) AS BIGINT) AS labels_used FROM embeddings")
def q_c4(spark, sf):
    return V.labels_used(_emb(spark, sf))


@register("c1_silhouette_sq", S.rounded(["silhouette"], {"silhouette"}, S.with_ctes(EMB_LONG) + """,
pd AS (SELECT a.vec_id AS i, b.vec_id AS j, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM emb a JOIN emb b ON a.d = b.d GROUP BY a.vec_id, b.vec_id),
lab AS (SELECT DISTINCT vec_id, label FROM emb),
sz AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
m AS (SELECT pd.i, lb.label AS cl, sum(pd.d2) AS tot FROM pd JOIN lab lb ON lb.vec_id = pd.j GROUP BY pd.i, lb.label),
ab AS (SELECT m.i, li.label AS own,
  max(CASE WHEN m.cl = li.label THEN m.tot / greatest(sz.n - 1, 1) END) AS a,
  min(CASE WHEN m.cl <> li.label THEN m.tot / sz.n END) AS b,
  max(CASE WHEN m.cl = li.label THEN sz.n END) AS own_n
  FROM m JOIN lab li ON li.vec_id = m.i JOIN sz ON sz.label = m.cl GROUP BY m.i, li.label)
SELECT avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM ab"""))
def q_c1(spark, sf):
    return round_doubles(V.silhouette(_emb(spark, sf)))


@register("c2_calinski_harabasz", S.rounded(["calinski_harabasz"], {"calinski_harabasz"}, S.with_ctes(EMB_LONG) + """,
cen AS (SELECT label, d, avg(v) AS c FROM emb GROUP BY label, d),
gm AS (SELECT d, avg(v) AS g FROM emb GROUP BY d),
n AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT label) AS k FROM emb),
nk AS (SELECT label, count(DISTINCT vec_id) AS nk FROM emb GROUP BY label),
w AS (SELECT sum((e.v - c.c) * (e.v - c.c)) AS w FROM emb e JOIN cen c ON e.label = c.label AND e.d = c.d),
b AS (SELECT sum(nk.nk * (c.c - gm.g) * (c.c - gm.g)) AS b FROM cen c JOIN gm ON c.d = gm.d JOIN nk ON nk.label = c.label)
SELECT (b.b / (n.k - 1)) / (w.w / (n.n - n.k)) AS calinski_harabasz FROM b, w, n"""))
def q_c2(spark, sf):
    return round_doubles(V.calinski_harabasz(_emb(spark, sf)))


@register("c3_davies_bouldin", S.rounded(["davies_bouldin"], {"davies_bouldin"}, S.with_ctes(EMB_LONG) + """,
cen AS (SELECT label, d, avg(v) AS c FROM emb GROUP BY label, d),
s AS (SELECT label, avg(dd) AS s FROM (SELECT e.vec_id, e.label, sqrt(sum((e.v - c.c) * (e.v - c.c))) AS dd
      FROM emb e JOIN cen c ON e.label = c.label AND e.d = c.d GROUP BY e.vec_id, e.label) t GROUP BY label),
cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dist FROM cen a JOIN cen b
       ON a.d = b.d AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT cd.i, max((si.s + sj.s) / cd.dist) AS r FROM cd JOIN s si ON si.label = cd.i JOIN s sj ON sj.label = cd.j GROUP BY cd.i)
SELECT avg(r) AS davies_bouldin FROM r"""))
def q_c3(spark, sf):
    return round_doubles(V.davies_bouldin(_emb(spark, sf)))


@register("c5_project_2d")
def q_c5(spark, sf):
    return round_doubles(V.project_2d(_emb(spark, sf)))


# --- A15-A17 --------------------------------------------------------------------------------
_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def _describe_sql(tab, col):
    return f"""SELECT '{col}' AS "column", stat, round(value, 6) AS value FROM (
  SELECT unnest(['count','mean','std','min','25%','50%','75%','max']) AS stat,
         unnest([CAST(count({col}) AS DOUBLE), avg({col}), stddev_samp({col}), CAST(min({col}) AS DOUBLE),
                 quantile_cont({col}, 0.25), quantile_cont({col}, 0.5), quantile_cont({col}, 0.75), CAST(max({col}) AS DOUBLE)]) AS value
  FROM {tab})"""


@register("a15_describe", _describe_sql("documents", "n_chars") + " UNION ALL " + _describe_sql("events", "value"))
def q_a15(spark, sf):
    d = ST.describe_table(table(spark, sf, "documents"), ["n_chars"])
    e = ST.describe_table(table(spark, sf, "events"), ["value"])
    return round_doubles(d.unionByName(e))


@register("a16_histogram", S.rounded(["bin", "lo", "hi", "count"], {"lo", "hi"}, """
WITH st AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
nb AS (SELECT CAST(greatest(ceil((hi - lo) / 5.0), 1) AS BIGINT) AS n FROM st),
b AS (SELECT CAST(least(floor((e.value - st.lo) / 5.0), nb.n - 1) AS BIGINT) AS bin FROM events e, st, nb WHERE e.value IS NOT NULL)
SELECT r.range AS bin, st.lo + r.range * 5.0 AS lo, st.lo + (r.range + 1) * 5.0 AS hi, CAST(count(b.bin) AS BIGINT) AS count
FROM st, nb, range(nb.n) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range, st.lo"""))
def q_a16(spark, sf):
    return round_doubles(ST.histogram(table(spark, sf, "events"), "value", width=5.0))


KDE_GRID = [float(i) for i in range(0, 101, 5)]


@register("a17_kde", S.rounded(["x", "density"], {"density"}, f"""
WITH vals AS (SELECT value AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY value),
st AS (SELECT count(value) AS n, stddev_samp(value) AS sd FROM events),
h AS (SELECT sd * pow(n, -0.2) AS h, n FROM st),
grid AS (SELECT CAST(unnest([{", ".join(repr(g) for g in KDE_GRID)}]) AS DOUBLE) AS x)
SELECT g.x, sum(v.c * exp(-0.5 * pow((g.x - v.v) / h.h, 2))) / (h.n * h.h * sqrt(2 * pi())) AS density
FROM grid g, vals v, h GROUP BY g.x, h.n, h.h"""))
def q_a17(spark, sf):
    return round_doubles(ST.kde(table(spark, sf, "events"), "value", KDE_GRID))


DEG_GRID = [float(i) for i in range(0, 400, 10)]


def _degree_kde_sql():
    from .q_graph import GRAPH_SQL
    return S.rounded(["x", "density"], {"density"}, GRAPH_SQL + f""",
vals AS (SELECT CAST(degree AS DOUBLE) AS v, count(*) AS c FROM deg GROUP BY degree),
st AS (SELECT count(degree) AS n, stddev_samp(degree) AS sd FROM deg),
hh AS (SELECT sd * pow(n, -0.2) AS h, n FROM st),
grid AS (SELECT CAST(unnest([{", ".join(repr(g) for g in DEG_GRID)}]) AS DOUBLE) AS x)
SELECT g.x, sum(v.c * exp(-0.5 * pow((g.x - v.v) / hh.h, 2))) / (hh.n * hh.h * sqrt(2 * pi())) AS density
FROM grid g, vals v, hh GROUP BY g.x, hh.n, hh.h""")


@register("g8_degree_kde", _degree_kde_sql())
def q_g8k(spark, sf):
    mem = G.memberships(narrow_messages(spark, sf))
    deg = G.degree(G.pair_weights(G.author_pairs(mem)), mem.select("author").distinct())
    return round_doubles(ST.kde(deg, "degree", DEG_GRID))


# --- D1-D5 ------------------------------------------------------------------------------------
DOCLAB = "(SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _doclab(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(l, "doc_id", "left")


def _rank_sql(src, x):
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


def _spearman_sql(src, pairs, key):
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, corr(ra, rb) AS rho FROM (
  SELECT {_rank_sql(src, a)} AS ra, {_rank_sql(src, b)} AS rb FROM {src} s WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t""")
    return S.rounded(["a", "b", "rho"], {"rho"}, " UNION ALL ".join(parts))


EV = "(SELECT event_id, CAST(value AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id, CAST(epoch(ts) AS DOUBLE) AS t FROM events)"
EV_COLS = ["value", "user_id", "event_id", "t"]


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", "user_id",
                                             F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("t"))


@register("d1_spearman", _spearman_sql(EV, [(a, b) for i, a in enumerate(EV_COLS) for b in EV_COLS[i + 1:]], "event_id"))
def q_d1(spark, sf):
    return round_doubles(ST.spearman(_events(spark, sf), EV_COLS, key="event_id"))


@register("d1_spearman_pairwise_nulls", _spearman_sql(DOCLAB, [("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic")], "doc_id"))
def q_d1n(spark, sf):
    return round_doubles(ST.spearman(_doclab(spark, sf), ["n_chars", "quality", "toxic"], key="doc_id"))


@register("w2_sort_by", _spearman_sql(EV, [(a, b) for i, a in enumerate(EV_COLS) for b in EV_COLS[i + 1:]], "event_id"))
def q_w2(spark, sf):
    return ST.spearman(_events(spark, sf), EV_COLS, key="event_id").transform(round_doubles).orderBy(F.desc("rho"))


@register("w3_strong", "SELECT * FROM (" + _spearman_sql(EV, [(a, b) for i, a in enumerate(EV_COLS) for b in EV_COLS[i + 1:]], "event_id") + ") WHERE abs(rho) > 0.7")
def q_w3(spark, sf):
    r = round_doubles(ST.spearman(_events(spark, sf), EV_COLS, key="event_id"))
    return r.filter(F.abs("rho") > 0.7)


@register("d2_average_rank", S.rounded(["doc_id", "feature", "value", "rank"], {"value", "rank"},
                                       f"SELECT doc_id, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value, {_rank_sql('documents', 'n_chars')} AS rank FROM documents"))
def q_d2(spark, sf):
    return round_doubles(ST.average_rank(table(spark, sf, "documents"), ["n_chars"], key="doc_id"))


SPLIT_SQL = "CAST(('0x' || substring(md5(concat('13:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3"


@register("d3_split", f"SELECT doc_id, {SPLIT_SQL} AS is_test FROM documents")
def q_d3(spark, sf):
    return ST.split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("d4_impute_mean", S.rounded(["doc_id", "is_test", "quality"], {"quality"}, f"""
WITH s AS (SELECT doc_id, quality, {SPLIT_SQL} AS is_test FROM {DOCLAB})
SELECT doc_id, is_test, coalesce(quality, (SELECT avg(quality) FROM s WHERE NOT is_test)) AS quality FROM s"""))
def q_d4(spark, sf):
    df = ST.split(_doclab(spark, sf).select("doc_id", "quality"), "doc_id")
    tr, te = ST.impute_mean(df.filter(~F.col("is_test")), df.filter(F.col("is_test")), ["quality"])
    return round_doubles(tr.unionByName(te)).select("doc_id", "is_test", *[c for c in tr.columns if c not in ("doc_id", "is_test")])


@register("d5_standardize", S.rounded(["doc_id", "is_test", "n_chars"], {"n_chars"}, f"""
WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, {SPLIT_SQL} AS is_test FROM documents),
f AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM s WHERE NOT is_test)
SELECT doc_id, is_test, (n_chars - f.m) / f.sd AS n_chars FROM s, f"""))
def q_d5(spark, sf):
    df = ST.split(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double")), "doc_id")
    tr, te = ST.standardize(df.filter(~F.col("is_test")), df.filter(F.col("is_test")), ["n_chars"])
    return round_doubles(tr.unionByName(te)).select("doc_id", "is_test", *[c for c in tr.columns if c not in ("doc_id", "is_test")])


# --- D10-D14 on (quality, toxic) -------------------------------------------------------------
def _lp(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@register("d10_class_weights", S.rounded(["label", "n_k", "weight"], {"weight"}, """
SELECT quality AS label, count(*) AS n_k, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight
FROM labels GROUP BY quality"""))
def q_d10(spark, sf):
    return round_doubles(ST.class_weights(_lp(spark, sf), "label"))


@register("d11_accuracy", "SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy FROM labels")
def q_d11(spark, sf):
    return round_doubles(ST.accuracy(_lp(spark, sf)))


@register("d14_confusion", "SELECT quality AS label, toxic AS prediction, count(*) AS count FROM labels GROUP BY quality, toxic")
def q_d14(spark, sf):
    return ST.confusion(_lp(spark, sf))


REPORT_SQL = """
WITH c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY quality, toxic),
cls AS (SELECT l AS cls FROM c UNION SELECT p FROM c),
per AS (
  SELECT CAST(cls.cls AS VARCHAR) AS cls,
    coalesce((SELECT sum(n) FROM c WHERE c.l = cls.cls), 0) AS support,
    coalesce((SELECT sum(n) FROM c WHERE c.p = cls.cls), 0) AS predicted,
    coalesce((SELECT sum(n) FROM c WHERE c.l = cls.cls AND c.p = cls.cls), 0) AS tp
  FROM cls),
per2 AS (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per2),
rep AS (
  SELECT cls, CAST(support AS BIGINT) AS support, precision, recall, f1 FROM per3
  UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM per3
  UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), sum(precision * support) / sum(support),
                   sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM per3)
"""


@register("d13_class_report", S.rounded(["cls", "support", "precision", "recall", "f1"], {"precision", "recall", "f1"}, REPORT_SQL + "SELECT * FROM rep"))
def q_d13(spark, sf):
    return round_doubles(ST.class_report(_lp(spark, sf)))


@register("d12_weighted_f1", REPORT_SQL + "SELECT round(f1, 6) AS weighted_f1 FROM rep WHERE cls = 'weighted avg'")
def q_d12(spark, sf):
    return round_doubles(ST.weighted_f1(_lp(spark, sf)))


# --- W5 / W6 -----------------------------------------------------------------------------------
@register("w5_union", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn AS id, text FROM conversations")
def q_w5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "text")
    return d.unionByName(c)


@register("w6_distinct", S.with_ctes(*S.BASE) + "SELECT DISTINCT author FROM clean WHERE author IS NOT NULL")
def q_w6(spark, sf):
    return clean_messages(spark, sf).select("author").filter(F.col("author").isNotNull()).distinct()


# --- N2-N4, N7 on the author graph -------------------------------------------------------------
X_COLS = ["total_message_count", "own_message", "forwarded_message", "was_forwarded"]
H_OUT = 3


def _author_x(spark, sf):
    clean = narrow_messages(spark, sf)
    agg = A.aggregate_features(clean, ["author"])
    x = agg.select("author", F.array(*[F.col(c).cast("double") for c in X_COLS]).alias("x"))
    mem = G.memberships(clean)
    edges = G.pair_weights(G.author_pairs(mem))
    return x, G.transition(edges, mem, t=2)


def _graph_sql():
    from .q_graph import GRAPH_SQL
    W = N.rule_weights(len(X_COLS), H_OUT)
    a_s = N.rule_weights(H_OUT, 1)[:, 0]
    a_n = (N.rule_weights(H_OUT + 1, 1)[1:, 0])
    wrows = ", ".join(f"({i}, {j}, {float(W[i, j])!r})" for i in range(W.shape[0]) for j in range(W.shape[1]))
    arows = ", ".join(f"({j}, {float(a_s[j])!r}, {float(a_n[j])!r})" for j in range(H_OUT))
    xs = " UNION ALL ".join(f"SELECT author, {i} AS i, CAST({c} AS DOUBLE) AS x FROM xa" for i, c in enumerate(X_COLS))
    return GRAPH_SQL + f""",
xa AS (SELECT c.author, count(*) AS total_message_count, sum(own_message) AS own_message,
        sum(forwarded_message) AS forwarded_message,
        coalesce((SELECT count(*) FROM clean f WHERE f.fwd_author = c.author), 0) AS was_forwarded
       FROM clean c WHERE c.author IS NOT NULL GROUP BY c.author),
xl AS ({xs}),
wm AS (SELECT * FROM (VALUES {wrows}) t(i, j, w)),
av AS (SELECT * FROM (VALUES {arows}) t(j, a_s, a_n)),
h AS (SELECT xl.author, wm.j, sum(xl.x * wm.w) AS h FROM xl JOIN wm ON xl.i = wm.i GROUP BY xl.author, wm.j),
fsn AS (SELECT h.author, sum(h.h * av.a_s) AS fs, sum(h.h * av.a_n) AS fn FROM h JOIN av ON h.j = av.j GROUP BY h.author),
mm AS (SELECT tp.src, tp.dst, (tp.t + coalesce(t2.t2, 0)) / 2 AS m FROM tp LEFT JOIN t2 ON tp.src = t2.src AND tp.dst = t2.dst),
e AS (SELECT mm.src, mm.dst, mm.m * (a.fs + b.fn) AS z FROM mm JOIN fsn a ON a.author = mm.src JOIN fsn b ON b.author = mm.dst),
e2 AS (SELECT src, dst, CASE WHEN z >= 0 THEN z ELSE z * 0.05 END AS e FROM e),
ex AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY src)) AS ex FROM e2),
att AS (SELECT src, dst, ex / sum(ex) OVER (PARTITION BY src) AS alpha FROM ex),
hp AS (SELECT att.src AS author, h.j, sum(att.alpha * h.h) AS v FROM att JOIN h ON h.author = att.dst GROUP BY att.src, h.j)
"""


def _weights():
    return N.rule_weights(len(X_COLS), H_OUT), N.rule_weights(H_OUT, 1)[:, 0], N.rule_weights(H_OUT + 1, 1)[1:, 0]


@register("n2_linear", S.rounded(["author", "k", "h"], {"h"}, _graph_sql() + "SELECT author, CAST(j AS INTEGER) AS k, h FROM h"))
def q_n2(spark, sf):
    x, _ = _author_x(spark, sf)
    W, _, _ = _weights()
    h = N.linear(x, W)
    return round_doubles(h.select("author", F.posexplode("h").alias("k", "h")))


@register("n3_edge_attention", S.rounded(["src", "dst", "alpha"], {"alpha"}, _graph_sql() + "SELECT src, dst, alpha FROM att"))
def q_n3(spark, sf):
    x, m = _author_x(spark, sf)
    W, a_s, a_n = _weights()
    return round_doubles(N.edge_attention(N.linear(x, W), m, a_s, a_n))


@register("n4_attend", S.rounded(["author", "k", "h"], {"h"}, _graph_sql() +
                                 "SELECT author, CAST(j AS INTEGER) AS k, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS h FROM hp"))
def q_n4(spark, sf):
    x, m = _author_x(spark, sf)
    W, a_s, a_n = _weights()
    h = N.linear(x, W)
    out = N.attend(N.edge_attention(h, m, a_s, a_n), h)
    return round_doubles(out.select("author", F.posexplode("h").alias("k", "h")))


@register("n7_decode", S.rounded(["src", "dst", "a_pred"], {"a_pred"}, _graph_sql() + """,
hn AS (SELECT author, j, v / sqrt(sum(v * v) OVER (PARTITION BY author)) AS z FROM (
        SELECT author, j, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS v FROM hp) t)
SELECT e.src, e.dst, 1 / (1 + exp(-sum(a.z * b.z))) AS a_pred FROM edges e
JOIN hn a ON a.author = e.src JOIN hn b ON b.author = e.dst AND a.j = b.j GROUP BY e.src, e.dst"""))
def q_n7(spark, sf):
    x, m = _author_x(spark, sf)
    W, a_s, a_n = _weights()
    h = N.linear(x, W)
    z = N.l2_normalize(N.attend(N.edge_attention(h, m, a_s, a_n), h))
    edges = G.pair_weights(G.author_pairs(G.memberships(narrow_messages(spark, sf)))).select("src", "dst")
    return round_doubles(N.decode(z, edges))


def _layer_sql(n: int, source: str, W, a_s, a_n, normalise: bool) -> str:
    """One attention layer as CTEs: y<n> (author, j, v) from ``source`` (author, i, x)."""
    wrows = ", ".join(f"({i}, {j}, {float(W[i, j])!r})" for i in range(W.shape[0]) for j in range(W.shape[1]))
    arows = ", ".join(f"({j}, {float(a_s[j])!r}, {float(a_n[j])!r})" for j in range(W.shape[1]))
    value = "v / greatest(sqrt(sum(v * v) OVER (PARTITION BY author)), 1e-12)" if normalise else "v"
    return f"""lh{n} AS (SELECT s.author, w.j, sum(s.x * w.w) AS h FROM {source} s JOIN (VALUES {wrows}) w(i, j, w) ON s.i = w.i GROUP BY s.author, w.j),
lf{n} AS (SELECT h.author, sum(h.h * a.a_s) AS fs, sum(h.h * a.a_n) AS fn FROM lh{n} h JOIN (VALUES {arows}) a(j, a_s, a_n) ON h.j = a.j GROUP BY h.author),
le{n} AS (SELECT mm.src, mm.dst, mm.m * (a.fs + b.fn) AS z FROM mm JOIN lf{n} a ON a.author = mm.src JOIN lf{n} b ON b.author = mm.dst),
lx{n} AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY src)) AS ex FROM (SELECT src, dst, CASE WHEN z >= 0 THEN z ELSE z * 0.05 END AS e FROM le{n}) t),
la{n} AS (SELECT src, dst, ex / sum(ex) OVER (PARTITION BY src) AS alpha FROM lx{n}),
ls{n} AS (SELECT a.src AS author, h.j, sum(a.alpha * h.h) AS s FROM la{n} a JOIN lh{n} h ON h.author = a.dst GROUP BY a.src, h.j),
y{n} AS (SELECT author, i, {value} AS x FROM (SELECT author, j AS i, CASE WHEN s > 0 THEN s ELSE exp(s) - 1 END AS v FROM ls{n}) t)"""


def _assign_sql(source: str, centres) -> str:
    """sq (author, k, q) of ``source`` (author, i, x) by the given centres."""
    crows = ", ".join(f"({k}, {d}, {float(centres[k, d])!r})" for k in range(centres.shape[0]) for d in range(centres.shape[1]))
    return f"""sd AS (SELECT s.author, c.k, sum((s.x - c.v) * (s.x - c.v)) AS d2 FROM {source} s JOIN (VALUES {crows}) c(k, d, v) ON s.i = c.d GROUP BY s.author, c.k),
sq AS (SELECT author, CAST(k AS INTEGER) AS k, pow(1.0 + d2, -1.5) / sum(pow(1.0 + d2, -1.5)) OVER (PARTITION BY author) AS q FROM sd)"""


ENC = N.rule_layers([len(X_COLS), 8, 4, 4], clusters=K_CENTRES)


def _encoder_sql(w, source: str, layers: int) -> str:
    parts = []
    for n in range(layers):
        parts.append(_layer_sql(n, source, w[f"W{n}"], w[f"a_self{n}"], w[f"a_neighs{n}"], n > 0))
        source = f"y{n}"
    return ",\n".join(parts)


@register("n5_encode", S.rounded(["author", "k", "z"], {"z"}, _graph_sql() + ",\n" + _encoder_sql(ENC, "xl", 2) +
                                 "\nSELECT author, CAST(i AS INTEGER) AS k, x AS z FROM y1"))
def q_n5(spark, sf):
    x, m = _author_x(spark, sf)
    z = N.encode(x, m, ENC)
    return round_doubles(z.select("author", F.posexplode("z").alias("k", "z")))


@register("n6_score_authors", S.rounded(["author", "k", "q"], {"q"}, _graph_sql() + ",\n" + _encoder_sql(ENC, "xl", 3) + ",\n" +
                                        _assign_sql("y2", ENC["centres"]) + "\nSELECT author, k, q FROM sq"))
def q_n6(spark, sf):
    x, m = _author_x(spark, sf)
    return round_doubles(N.score_authors(x, m, ENC, ENC["centres"]))


EPOCHS, RATE = 3, 0.5


def _epochs_sql() -> str:
    """Unrolled refinement: centres c0 .. cE, soft assignments q0 .. qE, targets p0 .. pE."""
    parts = [S.with_ctes(EMB_LONG) + f""", sz AS (SELECT count(DISTINCT vec_id) AS n FROM emb),
c0 AS (SELECT CAST(label % {K_CENTRES} AS INTEGER) AS k, d, avg(v) AS v FROM emb GROUP BY label % {K_CENTRES}, d)"""]
    for e in range(EPOCHS + 1):
        parts.append(f"""d{e} AS (SELECT e.vec_id, c.k, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM emb e JOIN c{e} c ON e.d = c.d GROUP BY e.vec_id, c.k),
q{e} AS (SELECT vec_id, k, d2, pow(1.0 + d2, -1.5) / sum(pow(1.0 + d2, -1.5)) OVER (PARTITION BY vec_id) AS q FROM d{e}),
f{e} AS (SELECT k, sum(q) AS f FROM q{e} GROUP BY k),
p{e} AS (SELECT q.vec_id, q.k, q.d2, q.q, (q.q * q.q / f.f) / sum(q.q * q.q / f.f) OVER (PARTITION BY q.vec_id) AS p FROM q{e} q JOIN f{e} f ON q.k = f.k),
h{e} AS (SELECT vec_id, k AS cluster FROM (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, k ASC) AS rn FROM q{e}) t WHERE rn = 1)""")
        if e < EPOCHS:
            parts.append(f"""c{e + 1} AS (SELECT c.k, c.d, c.v + {RATE} * 3.0 * sum((p.p - p.q) / (1.0 + p.d2) * (e.v - c.v)) / max(sz.n) AS v
  FROM c{e} c JOIN p{e} p ON p.k = c.k JOIN emb e ON e.vec_id = p.vec_id AND e.d = c.d, sz GROUP BY c.k, c.d, c.v)""")
    return ",\n".join(parts)


def _index_sql(e: int) -> str:
    """Calinski-Harabasz and Davies-Bouldin of the hard labels of epoch e."""
    return f"""m{e} AS (SELECT e.vec_id, h.cluster, e.d, e.v FROM emb e JOIN h{e} h ON h.vec_id = e.vec_id),
g{e} AS (SELECT cluster, d, avg(v) AS c, count(*) AS n FROM m{e} GROUP BY cluster, d),
w{e} AS (SELECT sum((m.v - g.c) * (m.v - g.c)) AS w FROM m{e} m JOIN g{e} g ON m.cluster = g.cluster AND m.d = g.d),
b{e} AS (SELECT sum(g.n * (g.c - a.c) * (g.c - a.c)) AS b FROM g{e} g JOIN (SELECT d, avg(v) AS c FROM emb GROUP BY d) a ON a.d = g.d),
u{e} AS (SELECT count(DISTINCT cluster) AS k FROM h{e}),
s{e} AS (SELECT cluster, avg(x) AS s FROM (SELECT m.vec_id, m.cluster, sqrt(sum((m.v - g.c) * (m.v - g.c))) AS x
  FROM m{e} m JOIN g{e} g ON m.cluster = g.cluster AND m.d = g.d GROUP BY m.vec_id, m.cluster) t GROUP BY cluster),
r{e} AS (SELECT i.cluster, max((si.s + sj.s) / j.x) AS r FROM (SELECT DISTINCT cluster FROM g{e}) i
  JOIN (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS x FROM g{e} a JOIN g{e} b ON a.d = b.d AND a.cluster <> b.cluster
        GROUP BY a.cluster, b.cluster) j ON j.ci = i.cluster JOIN s{e} si ON si.cluster = j.ci JOIN s{e} sj ON sj.cluster = j.cj GROUP BY i.cluster)"""


def _refinement(spark, sf):
    z = _emb(spark, sf).select(F.col("vec_id").alias("author"), N.to_double_array("embedding").alias("z"))
    return z, V.refine_epochs(z, _centres(spark, sf), epochs=EPOCHS, lr=RATE)


@register("n14_refine_centres", S.rounded(["author", "cluster"] + _PROB, set(_PROB), _epochs_sql() + f"""
SELECT h.vec_id AS author, h.cluster, """ + ", ".join(f"max(q.q) FILTER (WHERE q.k = {i}) AS cluster_{i}_prob" for i in range(K_CENTRES)) + f"""
FROM h{EPOCHS} h JOIN q{EPOCHS} q ON q.vec_id = h.vec_id GROUP BY h.vec_id, h.cluster"""))
def q_n14(spark, sf):
    _, states = _refinement(spark, sf)
    *_, (_, _, q) = states
    return round_doubles(N.cluster_table(q, K_CENTRES))


_S8_SQL = _epochs_sql() + ",\n" + ",\n".join(_index_sql(e) for e in range(EPOCHS + 1)) + "\n" + " UNION ALL ".join(f"""
SELECT {e} AS epoch, (SELECT sum(p * (ln(p) - ln(q))) FROM p{e}) / sz.n AS kl, u{e}.k AS assigned_clusters,
  (b{e}.b / (u{e}.k - 1)) / (w{e}.w / (sz.n - u{e}.k)) AS calinski_harabasz, (SELECT avg(r) FROM r{e}) AS davies_bouldin,
  {K_CENTRES} AS k, {RATE} AS lr FROM sz, u{e}, w{e}, b{e}""" for e in range(EPOCHS + 1))


@register("s8_log_metrics", f"""SELECT CAST(epoch AS BIGINT) AS epoch, round(kl, 6) AS kl, CAST(assigned_clusters AS BIGINT) AS assigned_clusters,
  round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin, CAST(k AS BIGINT) AS k,
  CAST(lr AS DOUBLE) AS lr FROM ({_S8_SQL})""")
def q_s8(spark, sf):
    """One metric row per epoch of the centre refinement (KL, clusters used,
    Calinski-Harabasz, Davies-Bouldin of the hard labels), appended with the
    run parameters to a Parquet log as the epochs run, then read back."""
    from ..session import scratch_path
    from ..sources.sinks import log_metrics
    z, states = _refinement(spark, sf)
    path = scratch_path(spark, "s8")
    for epoch, _, q in states:
        hard = N.hard_label(q).join(z, "author")
        used = V.labels_used(hard, "cluster").first()[0]
        row = {"epoch": epoch, "kl": float(N.kl(N.target_distribution(q), q).first()[0]), "assigned_clusters": int(used),
               "calinski_harabasz": V.calinski_harabasz(hard, "z", "cluster", "author").first()[0],
               "davies_bouldin": V.davies_bouldin(hard, "z", "cluster", "author").first()[0]}
        log_metrics(spark, [row], path, params={"k": K_CENTRES, "lr": RATE})
    return round_doubles(spark.read.parquet(path).select("epoch", "kl", "assigned_clusters", "calinski_harabasz", "davies_bouldin",
                                                         "k", "lr"))


@register("j10_attach_clusters", S.rounded(["vec_id", "label", "cluster"] + _PROB, set(_PROB), Q_SQL + """,
ct AS (SELECT h.vec_id, h.cluster, """ + ", ".join(f"max(q.q) FILTER (WHERE q.k = {i}) AS cluster_{i}_prob" for i in range(K_CENTRES)) + """
       FROM hard h JOIN q ON q.vec_id = h.vec_id GROUP BY h.vec_id, h.cluster)
SELECT e.vec_id, e.label, ct.* EXCLUDE (vec_id) FROM embeddings e JOIN ct ON ct.vec_id = e.vec_id"""))
def q_j10(spark, sf):
    """Features (here the label column) joined with the hard cluster
    and one probability column per cluster, on the key."""
    feats = _emb(spark, sf).select("vec_id", "label")
    return round_doubles(feats.join(N.cluster_table(_q(spark, sf), K_CENTRES, key="vec_id"), "vec_id"))


@register("s9_export_cluster_means", S.rounded(["label", "d", "mean"], {"mean"}, S.with_ctes(EMB_LONG) +
                                               "SELECT label, CAST(d AS INTEGER) AS d, avg(v) AS mean FROM emb GROUP BY label, d"))
def q_s9(spark, sf):
    """Cluster means written with the table writer (gzip CSV instead of
    xlsx) and read back."""
    from ..session import scratch_path
    from ..sources.sinks import write_table
    long = _emb(spark, sf).select("label", F.posexplode(N.to_double_array("embedding")).alias("d", "v"))
    means = ST.cluster_means(long, ["v"], label=["label", "d"]).withColumnRenamed("v", "mean")
    path = scratch_path(spark, "s9")
    write_table(means, path, fmt="csv")
    back = spark.read.option("header", True).schema("label int, d int, mean double").csv(path)
    return round_doubles(back)


def _scored_sql() -> str:
    from .authors import scored_weights
    from .q_authors import A2_COLS, _author_sql
    from .q_graph import GRAPH_SQL
    w = scored_weights()
    feats = "WITH " + GRAPH_SQL.lstrip()[len("WITH"):] + f""",
fe AS (SELECT * FROM ({_author_sql(A2_COLS, digits=None)}) t),
mm AS (SELECT tp.src, tp.dst, (tp.t + coalesce(t2.t2, 0)) / 2 AS m FROM tp LEFT JOIN t2 ON tp.src = t2.src AND tp.dst = t2.dst),
xs AS (""" + " UNION ALL ".join(f"SELECT author, {i} AS i, coalesce(CAST({c} AS DOUBLE), 0.0) AS x FROM fe" for i, c in enumerate(A.FEATURES_30)) + "),\n"
    feats += _encoder_sql(w, "xs", 3) + ",\n" + _assign_sql("y2", w["centres"]) + f""",
ct AS (SELECT author, arg_max(k, q) AS cluster, """ + ", ".join(f"max(q) FILTER (WHERE k = {i}) AS cluster_{i}_prob" for i in range(K_CENTRES)) + f"""
  FROM sq GROUP BY author),
dg AS (SELECT author, degree, CAST(degree AS DOUBLE) / nullif((SELECT count(*) FROM deg) - 1, 0) AS degree_centrality FROM deg)
SELECT fe.*, ct.* EXCLUDE (author), dg.* EXCLUDE (author) FROM fe LEFT JOIN ct ON ct.author = fe.author LEFT JOIN dg ON dg.author = fe.author"""
    return feats


def _register_scored():
    from .q_authors import A2_COLS, AUTHOR_DOUBLES
    cols = A2_COLS + ["cluster"] + _PROB + ["degree", "degree_centrality"]
    register("n13_scored_authors", S.rounded(cols, AUTHOR_DOUBLES | set(_PROB) | {"degree_centrality"}, _scored_sql()))(q_n13s)


def q_n13s(spark, sf):
    """End to end: 30 features, clusters and probabilities, degree."""
    from .authors import scored_authors
    return round_doubles(scored_authors(spark, sf))


_register_scored()
