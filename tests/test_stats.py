"""Ranks, correlations, histograms and classification metrics."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from authornet.operators import stats as ST
from authornet.operators import validity as V


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 10.0), (4, 30.0), (5, None)], "k int, x double").repartition(3)
    got = {r.k: r.rank for r in ST.average_rank(df, ["x"], "k").collect()}
    assert got == {1: 1.5, 3: 1.5, 2: 3.0, 4: 4.0}


def test_spearman_pairwise_deletion_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 40).astype(float)
    y = x + rng.normal(size=40)
    z = rng.normal(size=40)
    y[[1, 5, 9]] = np.nan
    z[[2, 5]] = np.nan
    pdf = pd.DataFrame({"k": range(40), "x": x, "y": y, "z": z})
    sdf = spark.createDataFrame([(int(r.k), *(None if math.isnan(v) else float(v) for v in (r.x, r.y, r.z)))
                                 for r in pdf.itertuples()], "k int, x double, y double, z double")
    got = {(r.a, r.b): r.rho for r in ST.spearman(sdf, ["x", "y", "z"], "k").collect()}
    exp = pdf[["x", "y", "z"]].corr(method="spearman")
    for (a, b), v in got.items():
        assert abs(v - exp.loc[a, b]) < 1e-12


def test_histogram_matches_numpy(spark):
    vals = [0.0, 1.0, 1.5, 2.0, 9.5, 10.0, 3.3]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["count"] for r in ST.histogram(df, "v", bins=4).orderBy("bin").collect()]
    assert got == list(np.histogram(vals, bins=4)[0])


def test_describe_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "v double")
    got = {r.stat: r.value for r in ST.describe_table(df, ["v"]).collect()}
    s = pd.Series([1, 2, 3, 4, 10], dtype=float).describe()
    for k in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]:
        assert abs(got[k] - s[k]) < 1e-12


def test_class_report(spark):
    y = [0, 0, 1, 1, 1, 2]
    p = [0, 1, 1, 1, 0, 2]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    rep = {r.cls: r for r in ST.class_report(df).collect()}
    # class 1: tp 2, predicted 3, support 3
    assert abs(rep["1"].precision - 2 / 3) < 1e-12 and abs(rep["1"].recall - 2 / 3) < 1e-12
    assert abs(ST.accuracy(df).first()[0] - 4 / 6) < 1e-12
    f1 = {c: rep[c].f1 for c in ["0", "1", "2"]}
    sup = {"0": 2, "1": 3, "2": 1}
    assert abs(rep["weighted avg"].f1 - sum(f1[c] * sup[c] for c in f1) / 6) < 1e-12
    conf = {(r.label, r.prediction): r["count"] for r in ST.confusion(df).collect()}
    assert conf[(1, 0)] == 1 and conf[(0, 1)] == 1


def test_validity_indices_match_numpy(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(60, 3))
    lab = rng.integers(0, 3, 60)
    X[lab == 1] += 2
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(60)], "vec_id int, embedding array<double>, label int")
    ks = sorted(set(lab))
    C = np.array([X[lab == k].mean(0) for k in ks])
    g = X.mean(0)
    B = sum((lab == k).sum() * ((C[i] - g) ** 2).sum() for i, k in enumerate(ks))
    W = sum(((X[lab == k] - C[i]) ** 2).sum() for i, k in enumerate(ks))
    ch = (B / (len(ks) - 1)) / (W / (60 - len(ks)))
    assert abs(V.calinski_harabasz(df).first()[0] - ch) < 1e-9
    s = np.array([np.linalg.norm(X[lab == k] - C[i], axis=1).mean() for i, k in enumerate(ks)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(C[i] - C[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    assert abs(V.davies_bouldin(df).first()[0] - db) < 1e-9
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    sil = []
    for i in range(60):
        own = lab == lab[i]
        a = D[i, own].sum() / max(own.sum() - 1, 1)
        b = min(D[i, lab == k].mean() for k in ks if k != lab[i])
        sil.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    assert abs(V.silhouette(df).first()[0] - np.mean(sil)) < 1e-9


def test_exact_quantiles_match_numpy(spark):
    vals = [5.0, 1.0, 1.0, 3.0, 8.0, 2.0, 2.0, 2.0, 9.5]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(vals)], "a double, b double").repartition(4)
    got = {(r.feature, r.p): r.value for r in ST.exact_quantiles(df, ["a", "b"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for c, arr in (("a", vals), ("b", [float(i) for i in range(len(vals))])):
        for p in (0.1, 0.25, 0.5, 0.9):
            assert abs(got[(c, p)] - np.quantile(arr, p)) < 1e-12


def test_multinomial_matches_balanced_objective(spark):
    rng = np.random.default_rng(11)
    n, d = 90, 3
    X = rng.normal(size=(n, d))
    y = (X[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int) + (X[:, 1] > 1).astype(int)
    df = spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(n)], "k int, x array<double>, label int")
    w = ST.class_weights(df, "label").select("label", "weight")
    model = ST.fit_multinomial(df.join(w, "label"), "x", "label", "weight", max_iter=5000)
    W = model.coefficientMatrix.toArray()
    b = model.interceptVector.toArray()
    K = W.shape[0]
    counts = np.bincount(y, minlength=K)
    s = n / (K * counts[y])
    logits = X @ W.T + b
    P = np.exp(logits - logits.max(1, keepdims=True))
    P /= P.sum(1, keepdims=True)
    Y = np.eye(K)[y]
    gW = ((P - Y) * s[:, None]).T @ X + W       # d/dW of sum s_i CE_i + 0.5 |W|^2
    gb = ((P - Y) * s[:, None]).sum(0)
    assert np.abs(gW).max() < 1e-3 and np.abs(gb).max() < 1e-3
    pred = {r.k: r for r in ST.predict(model, df, "x", "k").collect()}
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in pred.values())
    assert all(pred[i].prediction == int(np.argmax(P[i])) for i in range(n))


def test_projection_keeps_the_largest_variances(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 4)) * np.array([5.0, 2.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(80)], "vec_id int, embedding array<double>")
    got = np.array([(r.pc1, r.pc2) for r in V.project_2d(df).orderBy("vec_id").collect()])
    top = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1][:2]
    assert np.allclose(got.var(axis=0, ddof=1), top) and abs(np.cov(got.T)[0, 1]) < 1e-9


def test_too_many_clusters_are_refused_not_cut(spark, monkeypatch):
    import pytest
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 5) for i in range(20)], "vec_id int, embedding array<double>, label int")
    assert V.cluster_stats(df).count() == 5
    monkeypatch.setattr(V, "MAX_CLUSTERS", 4)
    with pytest.raises(ValueError):
        V.silhouette(df).collect()


def test_every_epoch_is_logged(spark):
    import __spark_entry__ as E
    rows = E.queries()["s8_log_metrics"](spark, "/root/testdata/sf0.001").orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [0, 1, 2, 3]
    assert len({(r.kl, r.calinski_harabasz, r.davies_bouldin) for r in rows}) == 4  # no epoch is a copy


def test_each_step_lowers_kl_to_its_own_target(spark):
    """The target is renewed every epoch, so only the divergence from the epoch's own
    target must fall with its step."""
    from authornet.operators import propagate as N
    rng = np.random.default_rng(4)
    Z = rng.normal(size=(40, 3))
    z = spark.createDataFrame([(i, Z[i].tolist()) for i in range(40)], "author int, z array<double>")
    states = [(q, N.target_distribution(q)) for _, _, q in V.refine_epochs(z, Z[:4] * 0.5, epochs=3, lr=0.3)]
    for (q, p), (after, _) in zip(states, states[1:]):
        assert N.kl(p, after).first()[0] < N.kl(p, q).first()[0]


def test_spearman_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, float(i * i), 3.0 if i > 2 else None) for i in range(5)], "k int, x double, one double, y double, z double")
    got = {(r.a, r.b): r.rho for r in ST.spearman(df, ["x", "one", "y", "z"], "k").collect()}
    assert abs(got.pop(("x", "y")) - 1) < 1e-12 and len(got) == 5 and set(got.values()) == {None}
