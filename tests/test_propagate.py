"""Attention layer and soft clustering invariants, checked against NumPy."""
import numpy as np
from pyspark.sql import functions as F

from authornet.operators import propagate as N


def test_attention_softmax_and_aggregate(spark):
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "author string, x array<double>")
    m = spark.createDataFrame([("a", "a", 0.5), ("a", "b", 0.3), ("b", "a", 0.2), ("b", "b", 0.6), ("c", "c", 1.0),
                               ("b", "c", 0.1)], "src string, dst string, m double")
    W = np.array([[0.5, -1.0, 0.2], [0.3, 0.7, -0.4]])
    a_s, a_n = np.array([0.1, -0.2, 0.3]), np.array([0.4, 0.1, -0.5])
    h = N.linear(x, W)
    att = N.edge_attention(h, m, a_s, a_n)
    sums = {r.src: r.s for r in att.groupBy("src").agg(F.sum("alpha").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    out = {r.author: np.array(r.h) for r in N.attend(att, h).collect()}
    # dense reference
    X = {"a": np.array([1.0, 0.0]), "b": np.array([0.0, 2.0]), "c": np.array([1.0, 1.0])}
    H = {k: v @ W for k, v in X.items()}
    edges = {}
    for s, d, mv in [("a", "a", 0.5), ("a", "b", 0.3), ("b", "a", 0.2), ("b", "b", 0.6), ("c", "c", 1.0), ("b", "c", 0.1)]:
        z = mv * (H[s] @ a_s + H[d] @ a_n)
        edges.setdefault(s, []).append((d, z if z >= 0 else 0.05 * z))
    for s, lst in edges.items():
        e = np.array([v for _, v in lst])
        al = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        hp = sum(a * H[d] for a, (d, _) in zip(al, lst))
        hp = np.where(hp > 0, hp, np.exp(hp) - 1)
        assert np.allclose(out[s], hp, atol=1e-12)


def test_soft_assign_target_kl(spark):
    rng = np.random.default_rng(1)
    Z = rng.normal(size=(20, 4))
    Z /= np.linalg.norm(Z, axis=1, keepdims=True)
    C = Z[:3]
    z = spark.createDataFrame([(i, Z[i].tolist()) for i in range(20)], "author int, z array<double>")
    q = N.soft_assign(z, C)
    qd = (1 + ((Z[:, None, :] - C[None]) ** 2).sum(-1)) ** -1.5
    qd = qd / qd.sum(1, keepdims=True)
    for r in q.collect():
        assert abs(r.q - qd[r.author, r.k]) < 1e-12
    w = qd ** 2 / qd.sum(0)
    pd_ = w / w.sum(1, keepdims=True)
    p = N.target_distribution(q)
    for r in p.collect():
        assert abs(r.p - pd_[r.author, r.k]) < 1e-12
    kl = N.kl(p, q).first()[0]
    assert abs(kl - (pd_ * (np.log(pd_) - np.log(qd))).sum() / 20) < 1e-12
    hard = {r.author: r.cluster for r in N.hard_label(q).collect()}
    assert all(hard[i] == int(np.argmax(qd[i])) for i in range(20))


def test_hard_label_ties_go_to_lowest(spark):
    q = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.4), (1, 2, 0.2)], "author int, k int, q double")
    assert N.hard_label(q).first().cluster == 0


def test_encoder_rows_are_unit_length(spark):
    x = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "author string, x array<double>")
    m = spark.createDataFrame([("a", "a", 0.6), ("a", "b", 0.4), ("b", "a", 0.4), ("b", "b", 0.6)],
                              "src string, dst string, m double")
    w = N.init_weights([2, 4, 3], seed=1)
    for r in N.encode(x, m, w).collect():
        assert abs(np.linalg.norm(r.z) - 1) < 1e-12
    assert N.total_loss(0.1, 0.2, None) is None
    assert abs(N.total_loss(0.1, 0.2, 0.5) - (0.3 + 0.5)) < 1e-12


def test_centre_refinement_lowers_kl(spark):
    from authornet.operators import validity as V
    rng = np.random.default_rng(5)
    Z = np.vstack([rng.normal(loc=c, scale=0.3, size=(15, 3)) for c in ([0, 0, 2], [2, 0, 0], [0, 2, 0])])
    Z /= np.linalg.norm(Z, axis=1, keepdims=True)
    z = spark.createDataFrame([(i, Z[i].tolist()) for i in range(len(Z))], "author int, z array<double>")
    C0 = V.refine_centres(z, 3, epochs=0, seed=1)
    C1 = V.refine_centres(z, 3, epochs=5, lr=0.5, seed=1)
    def kl(C):
        q = N.soft_assign(z, C)
        return N.kl(N.target_distribution(q), q).first()[0]
    assert C0.shape == C1.shape == (3, 3)
    assert kl(C1) < kl(C0)
