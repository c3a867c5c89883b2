"""Registered queries for the cluster analysis on the 30 author features: clusters
attached, means and sizes, rank correlation of every feature with every cluster
probability, and the regression of the cluster on the features (split, impute, scale, weigh,
fit, predict, report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import neighbours as NB
from ..operators import stats as ST
from . import sqltwin as S
from .analysis import analysis_tables
from .authors import round_doubles
from .catalog import register
from .q_authors import A2_COLS, AUTHOR_DOUBLES
from .q_stats import _PROB, _scored_sql

SCORED = f"WITH sc AS MATERIALIZED ({_scored_sql()})"
_COLS = A2_COLS + ["cluster"] + _PROB
_LONG = SCORED + """, fl AS (""" + " UNION ALL ".join(
    f"SELECT author, cluster, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) AS value FROM sc" for c in A.FEATURES_30) + """),
pl AS (""" + " UNION ALL ".join(f"SELECT author, '{c}' AS prob, round(CAST({c} AS DOUBLE), 6) AS p FROM sc" for c in _PROB) + ")\n"
_RHO = _LONG + """, pr AS (SELECT f.author, f.feature AS a, l.prob AS b, f.value, l.p FROM fl f JOIN pl l ON l.author = f.author
  WHERE f.value IS NOT NULL AND l.p IS NOT NULL),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY value) + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY a, b ORDER BY p) + (count(*) OVER (PARTITION BY a, b, p) - 1) / 2.0 AS rb FROM pr),
rho AS (SELECT a, b, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY a, b)
"""


def _scored(spark, sf):
    """Rounded on both sides, so that values equal but for the last bits are ties to both."""
    return round_doubles(analysis_tables(spark, sf)["scored"])


@register("j10_scored_features", S.rounded(_COLS, AUTHOR_DOUBLES | set(_PROB), SCORED + " SELECT * FROM sc"))
def q_j10s(spark, sf):
    """All 30 features with the hard cluster and its probabilities."""
    return round_doubles(_scored(spark, sf).select(*_COLS))


@register("a14_feature_means", S.rounded(["cluster", "feature", "mean", "size"], {"mean"}, _LONG + """
SELECT f.cluster, f.feature, avg(f.value) AS mean, CAST(count(*) AS BIGINT) AS size FROM fl f WHERE f.cluster IS NOT NULL GROUP BY f.cluster, f.feature"""))
def q_a14f(spark, sf):
    """Mean of every feature per cluster, with the cluster's size."""
    means = ST.means_with_counts(_scored(spark, sf).filter(F.col("cluster").isNotNull()), A.FEATURES_30, by="cluster")
    long = means.select("cluster", "size", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("mean")) for c in A.FEATURES_30])).alias("r"))
    return round_doubles(long.select("cluster", "r.feature", "r.mean", "size"))


def _rho(spark, sf):
    r = ST.spearman(_scored(spark, sf), A.FEATURES_30, key="author", target=_PROB)
    return r.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


@register("d1_feature_cluster_spearman", S.rounded(["a", "b", "rho"], {"rho"}, _RHO + "SELECT * FROM rho"))
def q_d1f(spark, sf):
    return round_doubles(_rho(spark, sf))


@register("w2_sorted_correlations", "SELECT * FROM (" + S.rounded(["a", "b", "rho"], {"rho"}, _RHO + "SELECT * FROM rho WHERE rho IS NOT NULL") + ") ORDER BY rho DESC, a, b")
def q_w2f(spark, sf):
    return round_doubles(_rho(spark, sf).filter(F.col("rho").isNotNull())).orderBy(F.desc("rho"), "a", "b")


@register("w3_strong_correlations", "SELECT * FROM (" + S.rounded(["a", "b", "rho"], {"rho"}, _RHO + "SELECT * FROM rho") + ") WHERE abs(rho) > 0.7")
def q_w3f(spark, sf):
    return round_doubles(_rho(spark, sf)).filter(F.abs("rho") > 0.7)


_SPLIT = "CAST(('0x' || substring(md5(concat('13:', author)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3"
_PREP = _LONG + f""", sp AS (SELECT f.author, f.feature, f.value, {_SPLIT} AS is_test FROM fl f WHERE f.cluster IS NOT NULL),
m AS (SELECT feature, avg(value) AS m FROM sp WHERE NOT is_test GROUP BY feature),
im AS (SELECT sp.author, sp.feature, sp.is_test, coalesce(sp.value, m.m, 0.0) AS value FROM sp JOIN m ON m.feature = sp.feature),
st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM im WHERE NOT is_test GROUP BY feature),
z AS (SELECT im.author, im.feature, im.is_test, (im.value - st.m) / CASE WHEN st.s > 0 THEN st.s ELSE 1 END AS value
      FROM im JOIN st ON st.feature = im.feature)
"""


def _prepared(spark, sf):
    """D3 -> D4 -> D5 on the 30 features; label: the cluster's index among those used."""
    scored = _scored(spark, sf).filter(F.col("cluster").isNotNull()).select("author", "cluster", *A.FEATURES_30)
    parts = ST.split(scored, "author")
    train, test = ST.impute_mean(parts.filter(~F.col("is_test")), parts.filter("is_test"), A.FEATURES_30)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in A.FEATURES_30}  # a feature no training row has
    return ST.standardize(train.withColumns(zero), test.withColumns(zero), A.FEATURES_30)


@register("d5_prepared_features", S.rounded(["author", "feature", "is_test", "value"], {"value"}, _PREP + "SELECT * FROM z"))
def q_d5f(spark, sf):
    train, test = _prepared(spark, sf)
    both = train.unionByName(test)
    long = both.select("author", "is_test", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in A.FEATURES_30])).alias("r"))
    return round_doubles(long.select("author", "r.feature", "is_test", "r.value"))


def _fitted(spark, sf):
    train, test = _prepared(spark, sf)
    x = F.array(*[F.col(c) for c in A.FEATURES_30]).alias("x")
    label = F.col("cluster").cast("int").alias("label")
    train, test = train.select("author", x, label), test.select("author", x, label)
    weights = ST.class_weights(train, "label").select("label", "weight")  # one row per cluster
    train = train.join(F.broadcast(weights), "label")
    return ST.fit_multinomial(train, "x", "label", "weight"), train, test


def _fitted_resampled(spark, sf):
    """The same with over- and under-sampled training rows (D6, D7) before the weights; a class that
    resampling leaves without rows is not fitted.  Without any row left the rows stay as they are."""
    train, test = _prepared(spark, sf)
    x = F.array(*[F.col(c) for c in A.FEATURES_30]).alias("x")
    label = F.col("cluster").cast("int").alias("label")
    train, test = train.select("author", x, label), test.select("author", x, label)
    made = NB.smote_enn(train, "author", "x", "label").select(F.col("key").alias("author"), "x", "label")
    train = made if made.limit(1).count() else train
    weights = ST.class_weights(train, "label").select("label", "weight")  # one row per cluster
    return ST.fit_multinomial(train.join(F.broadcast(weights), "label"), "x", "label", "weight"), train, test


@register("d8_gradient_at_fit", SCORED + f""", tr AS (SELECT cluster FROM sc WHERE cluster IS NOT NULL AND NOT ({_SPLIT}))
SELECT CAST(k.k AS INTEGER) AS class, CAST(j.j AS INTEGER) AS feature, true AS at_optimum
FROM (SELECT unnest(range(CAST((SELECT max(cluster) + 1 FROM tr) AS BIGINT))) AS k) k, (SELECT unnest(range(-1, {len(A.FEATURES_30)})) AS j) j""")
def q_d8g(spark, sf):
    """D8 stated so that SQL can: at the fit every component of the gradient is 0
    (within 1e-3 of a unit of weight)."""
    model, train, _ = _fitted(spark, sf)
    g = ST.loss_gradient(model, train, "x")
    return g.select("class", "feature", (F.abs("gradient") < 1e-3).alias("at_optimum"))


@register("d9_predict_cluster")
def q_d9c(spark, sf):
    """Predicted cluster and probabilities of the held-out authors, from the resampled training rows."""
    model, _, test = _fitted_resampled(spark, sf)
    return ST.predict(model, test, "x", "author").join(test.select("author", "label"), "author")


@register("d13_cluster_report")
def q_d13c(spark, sf):
    """Report (D11-D14) of those predictions."""
    return round_doubles(ST.class_report(q_d9c(spark, sf)))
