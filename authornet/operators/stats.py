"""Descriptive statistics, ranks and supervised-validation metrics
(A13-A17, J8, D1-D5, D10-D14).

Global orderings (ranks, positions) are never computed with a window that
has no partition key: values are range-partitioned, ranked inside each
partition, and shifted by per-partition offsets taken from a tiny
aggregate (one row per partition and column).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_offsets, cut_lineage


# --- A13-A17, J8 -------------------------------------------------------------------

def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """A13."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def cluster_means(df: DataFrame, cols, label: str = "cluster") -> DataFrame:
    """Mean of every feature per cluster."""
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def means_with_counts(df: DataFrame, cols, by: str = "cluster") -> DataFrame:
    """Cluster means with cluster sizes, in one aggregation (the
    reference joins two tables)."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("size"))


def exact_quantiles(df: DataFrame, cols, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy / pandas default),
    computed from distributed cumulative counts of the distinct values: no
    task ever holds a whole column.  Returns (feature, p, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("r")).select("r.*").filter(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = _cumulative_before(vc, ["feature"], "value", "n")
    tot = vc.groupBy("feature").agg(F.sum("n").alias("total"))
    # 0-based target positions per probability (lower and upper neighbour)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    tgt = tot.select("feature", "total", F.explode(ps).alias("p")) \
        .withColumn("pos", (F.col("total") - 1) * F.col("p")) \
        .withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
    # tgt has (#columns x #probabilities) rows - a bounded broadcast, so the
    # cumulative table is filtered where it lies instead of shuffled by column
    hit = lambda which: (cum.join(F.broadcast(tgt), "feature")
                         .filter((F.col("before") <= F.col(which)) & (F.col(which) < F.col("before") + F.col("n")))
                         .select("feature", "p", "pos", "lo", F.col("value").alias(f"v_{which}")))
    both = hit("lo").join(hit("hi").select("feature", "p", "v_hi"), ["feature", "p"])
    return both.select("feature", "p", (F.col("v_lo") + (F.col("pos") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))).alias("value"))


def describe_table(df: DataFrame, cols, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation),
    max per column, long form (column, stat, value).  Exact quantiles come
    from distributed cumulative counts (``exact_quantiles``);
    ``exact=False`` uses ``percentile_approx`` (bounded sketch)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"{c}|pct"))
    wide = df.agg(*aggs)
    if exact:
        q = exact_quantiles(df, cols)
        qa = q.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))),
                                                  lambda s: s["value"]).alias("pct"))  # 3 rows per column
        pcts = {r["feature"]: r["pct"] for r in qa.collect()}  # one short list per column
        wide = wide.withColumns({f"{c}|pct": F.array(*[F.lit(v) for v in (pcts.get(c) or [None] * 3)]).cast("array<double>")
                                 for c in cols})
    rows = []
    for c in cols:
        rows += [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), v.alias("value")) for s, v in [
            ("count", F.col(f"`{c}|count`")), ("mean", F.col(f"`{c}|mean`")), ("std", F.col(f"`{c}|std`")),
            ("min", F.col(f"`{c}|min`")), ("25%", F.col(f"`{c}|pct`")[0]), ("50%", F.col(f"`{c}|pct`")[1]),
            ("75%", F.col(f"`{c}|pct`")[2]), ("max", F.col(f"`{c}|max`"))]]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, width: float | None = None, bins: int | None = None,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Fixed-width or fixed-count bins over [lo, hi] (the last bin is
    closed, like numpy).  With neither ``width`` nor ``bins``, Sturges' rule
    from one stats pass.  Returns every bin: (bin, lo, hi, count)."""
    x = F.col(col).cast("double")
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n")).first()
    lo = st["mn"] if lo is None else lo
    hi = st["mx"] if hi is None else hi
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, count bigint")
    if width is None:
        bins = bins or max(int(math.ceil(math.log2(max(st["n"], 1)) + 1)), 1)
        width = (hi - lo) / bins if hi > lo else 1.0
    else:
        bins = max(int(math.ceil((hi - lo) / width)), 1)
    idx = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = (df.filter((x >= lo) & (x <= hi)).groupBy(idx.cast("bigint").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def kde(df: DataFrame, col: str, grid: list[float], bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on a fixed grid.  Values are first
    reduced to (value, count); each distinct value then adds its kernel to
    every grid point through an array expression (grid size is a bounded
    parameter), and the contributions are summed per grid point.
    Bandwidth defaults to Scott's rule, n^(-1/5) * sample std."""
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd")).first()
    n, sd = st["n"], st["sd"] or 1.0
    h = bandwidth or (sd * n ** (-0.2) if n > 0 else 1.0)
    vc = df.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("v").isNotNull())
    g = F.array(*[F.lit(float(v)) for v in grid])
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    contrib = vc.select(F.posexplode(F.transform(g, lambda p: F.col("c") * F.exp(-0.5 * F.pow((p - F.col("v")) / h, 2))))
                        .alias("i", "k"))
    dens = contrib.groupBy("i").agg((F.sum("k") * F.lit(norm)).alias("density"))
    pts = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(grid)], "i int, x double")
    return pts.join(dens, "i", "left").select("x", F.coalesce("density", F.lit(0.0)).alias("density"))


# --- D2 average rank, D1 Spearman -------------------------------------------------------

def average_rank(df: DataFrame, cols, key: str) -> DataFrame:
    """Average ranks (ties share the mean rank) of several columns,
    long form (key, feature, value, rank).  Nulls get no rank."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                              for c in cols])).alias("r")).select(key, "r.*")
    long = long.filter(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    before = _cumulative_before(vc, ["feature"], "value", "n")
    ranked = before.select("feature", "value", ((2 * F.col("before") + F.col("n") + 1) / 2.0).alias("rank"))
    # one row per distinct value: AQE broadcasts it at run time when small;
    # otherwise a shuffle join whose hot values (ties) the skew handling splits
    return long.join(ranked, ["feature", "value"]).select(key, "feature", "value", "rank")


def _cumulative_before(df: DataFrame, part_cols, order: str, weight: str) -> DataFrame:
    """Per row, the sum of ``weight`` over rows of the same ``part_cols``
    with a smaller ``order`` value: range partition, local running sums,
    per-partition totals (tiny) turned into offsets."""
    keys = list(part_cols) + [order]
    sorted_df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # pin the partition ids: both branches below must see the same ones
    part = cut_lineage(sorted_df.withColumn("_p", F.spark_partition_id()))
    local = part.withColumn("_loc", F.sum(weight).over(
        Window.partitionBy("_p", *part_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    totals = part.groupBy("_p", *part_cols).agg(F.sum(weight).alias("_t"))
    offs = totals.select("_p", *part_cols, F.coalesce(F.sum("_t").over(
        Window.partitionBy(*part_cols).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(broadcast_offsets(offs), ["_p", *part_cols])
            .withColumn("before", F.col("_off") + F.coalesce("_loc", F.lit(0))).drop("_p", "_loc", "_off"))


def spearman(df: DataFrame, cols, key: str, target=None) -> DataFrame:
    """Spearman correlation with pairwise deletion: for each pair of
    columns (or each column against each of ``target``, a name or several), rows missing
    either value are dropped and ranks are taken on the remaining rows.  Long form
    (a, b, rho).

    All pairs go through one pass: a row per (pair, key) with both values, the counts
    of the values of each (pair, side), one running sum over those for the average ranks, and one
    correlation aggregate.  Columns without nulls would repeat the same ranks in each
    of their pairs, so pairs of two such columns share one side per column."""
    cols = list(cols)
    targets = [target] if isinstance(target, str) else list(target or [])
    df = df.withColumn("_key", F.col(key))  # the key may itself be a ranked column
    pairs = [(a, t) for t in targets for a in cols if a != t] if targets else \
        [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    involved = sorted({c for p in pairs for c in p})
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in involved]).first().asDict()
    whole = {c for c in involved if not nulls[c]}

    def side(a: str, b: str, c: str) -> str:
        return c if a in whole and b in whole else f"{a}|{b}|{c}"

    values = {side(a, b, c): (a, b, c) for a, b in pairs for c in (a, b)}
    # the lists of sides and pairs are literals walked by a transform, so the plan stays small
    columns = F.create_map(*[x for c in involved for x in (F.lit(c), F.col(c).cast("double"))])
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                      for name, (a, b, c) in values.items()])
    at = lambda name: F.element_at("_v", name)
    rows = F.transform(sides, lambda r: F.struct(r["side"].alias("side"), F.when(
        at(r["a"]).isNotNull() & at(r["b"]).isNotNull(), at(r["c"])).alias("value")))
    long = df.select("_key", columns.alias("_v")).select("_key", F.explode(rows).alias("r")).select("_key", "r.*") \
        .filter(F.col("value").isNotNull())
    counts = long.groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = _cumulative_before(counts, ["side"], "value", "n").select(
        "side", "value", ((2 * F.col("before") + F.col("n") + 1) / 2.0).alias("rank"))
    ranks = long.join(ranked, ["side", "value"]).groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("side", "rank"))).alias("ranks"))  # one entry per side
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(side(a, b, a)).alias("sa"),
                                F.lit(side(a, b, b)).alias("sb")) for a, b in pairs])
    each = ranks.select(F.explode(F.transform(listed, lambda p: F.struct(
        p["a"].alias("a"), p["b"].alias("b"), F.try_element_at("ranks", p["sa"]).alias("ra"),
        F.try_element_at("ranks", p["sb"]).alias("rb")))).alias("p")).select("p.*")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    spread = F.stddev_pop(F.when(both, F.col("ra"))) * F.stddev_pop(F.when(both, F.col("rb")))
    # a constant side has no correlation; corr() itself would divide by zero there
    return each.groupBy("a", "b").agg(F.try_divide(F.covar_pop("ra", "rb"), spread).alias("rho"))


# --- D3-D5 ----------------------------------------------------------------------------------

def split(df: DataFrame, key: str, test: float = 0.3, seed: int = 13) -> DataFrame:
    """D3: repeatable train/test flag from a seeded hash of the key."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10) \
        .cast("double") / F.lit(float(1 << 32))
    return df.withColumn("is_test", u < F.lit(test))


def impute_mean(train: DataFrame, test: DataFrame, cols, fit_on: str = "train"):
    """Replace nulls by column means fitted on ``train`` (or on each
    part separately with ``fit_on='each'``, as the reference does)."""
    def fit(d):
        r = d.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return {c: r[c] for c in cols}
    mt = fit(train)
    me = mt if fit_on == "train" else fit(test)
    fill = lambda d, m: d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m[c])) for c in cols})
    return fill(train, mt), fill(test, me)


def standardize(train: DataFrame, test: DataFrame, cols, fit_on: str = "train"):
    """(x - mean) / population std, fitted on ``train`` (std 0 -> 1)."""
    def fit(d):
        r = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        return {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in cols}
    ft = fit(train)
    fe = ft if fit_on == "train" else fit(test)
    tr = lambda d, f: d.withColumns({c: (F.col(c) - F.lit(f[c][0])) / F.lit(f[c][1]) for c in cols})
    return tr(train, ft), tr(test, fe)


# --- D10-D14 ------------------------------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (K * n_k)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_k"))
    tot = counts.agg(F.sum("n_k").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label, "n_k", (F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("n_k"))).alias("weight"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """D11."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Long form (label, prediction, count)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and
    weighted averages (zero where undefined, as scikit-learn reports)."""
    c = confusion(df, label, pred)
    tp = c.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    sup = c.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    prd = c.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    per = (sup.join(prd, "cls", "full").join(tp, "cls", "left")
           .select(F.col("cls").cast("string").alias("cls"),
                   F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("predicted", F.lit(0)).alias("predicted")))
    per = per.select("cls", "support",
                     F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0)).alias("precision"),
                     F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0)).alias("recall"))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    macro = per.agg(F.lit("macro avg").alias("cls"), F.sum("support").alias("support"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = per.agg(F.lit("weighted avg").alias("cls"), F.sum("support").alias("support"), w("precision"), w("recall"), w("f1"))
    return per.unionByName(macro).unionByName(weighted).withColumn("support", F.col("support").cast("bigint"))


def weighted_f1(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """D12."""
    return class_report(df, label, pred).filter(F.col("cls") == "weighted avg").select(F.col("f1").alias("weighted_f1"))


# --- D8/D9 ----------------------------------------------------------------------------------------

def fit_multinomial(df: DataFrame, x: str, label: str = "label", weight: str | None = "weight",
                    max_iter: int = 5000):
    """Multinomial logistic regression with L2 penalty; with balanced
    class weights (D10) and ``regParam = 1 / sum(weights)`` it optimises the
    same objective as an unscaled-C=1 fit on the weighted sum of losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = df.withColumn("_features", array_to_vector(F.col(x)))
    total = data.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=max_iter,
                            regParam=1.0 / float(total), elasticNetParam=0.0, standardization=False,
                            **({"weightCol": weight} if weight else {}))
    return lr.fit(data)


def loss_gradient(model, df: DataFrame, x: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """Gradient of D8's objective per (class, feature) at the fitted weights, per unit of
    total weight (feature -1: intercept): about 0 everywhere is what makes a fit a fit."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = model.transform(df.withColumn("_features", array_to_vector(F.col(x))))
    err = F.transform(vector_to_array("probability"), lambda p, k: F.col(weight) * (p - (k == F.col(label)).cast("double")))
    rows = out.select(F.posexplode(err).alias("class", "e"), F.array_insert(x, 1, F.lit(1.0)).alias("x"))
    cells = rows.select("class", "e", F.posexplode("x").alias("feature", "v"))
    sums = cells.groupBy("class", (F.col("feature") - 1).alias("feature")).agg(F.sum(F.col("e") * F.col("v")).alias("g"))
    total = df.agg(F.sum(weight)).first()[0]
    coef = [(int(k), int(j), float(v)) for k, row in enumerate(model.coefficientMatrix.toArray()) for j, v in enumerate(row)]
    coef += [(k, -1, 0.0) for k in range(model.coefficientMatrix.numRows)]
    w = df.sparkSession.createDataFrame(coef, "class int, feature int, w double")
    return sums.join(w, ["class", "feature"]).select("class", "feature", ((F.col("g") + F.col("w")) / total).alias("gradient"))


def predict(model, df: DataFrame, x: str, key: str) -> DataFrame:
    """Predicted class and class probabilities as an array."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = model.transform(df.withColumn("_features", array_to_vector(F.col(x))))
    return out.select(key, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability").alias("probability"))
