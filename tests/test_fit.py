"""Reconstruction loss by moments, gradients, fit and search against dense NumPy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from authornet.operators import fit as FT
from authornet.operators import propagate as N
from authornet.operators import reconstruction as R

RNG = np.random.default_rng(0)
NODES = 14
X = RNG.normal(size=(NODES, 3))
A = np.triu((RNG.random((NODES, NODES)) < 0.3) * RNG.integers(1, 4, (NODES, NODES)), 1)
A[:, -1] = 0  # a node without edges
A = A + A.T
SUPPORT = (A > 0) | np.eye(NODES, dtype=bool)
M = RNG.random((NODES, NODES)) * SUPPORT
NAME = [f"n{i:02d}" for i in range(NODES)]


@pytest.fixture(scope="module")
def graph(spark):
    x = spark.createDataFrame([(NAME[i], X[i].tolist()) for i in range(NODES)], "author string, x array<double>")
    cells = [(i, j) for i in range(NODES) for j in range(NODES)]
    m = spark.createDataFrame([(NAME[i], NAME[j], float(M[i, j])) for i, j in cells if SUPPORT[i, j]], "src string, dst string, m double")
    e = spark.createDataFrame([(NAME[i], NAME[j], int(A[i, j])) for i, j in cells if i < j and A[i, j]], "src string, dst string, weight long")
    return x, m, e


def dense(w):
    """(loss, z) over all cells."""
    y = X
    for layer in (0, 1):
        h = y @ w[f"W{layer}"]
        z = M * ((h @ w[f"a_self{layer}"])[:, None] + (h @ w[f"a_neighs{layer}"])[None, :])
        e = np.where(SUPPORT, np.where(z >= 0, z, 0.05 * z), -np.inf)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        s = (a / a.sum(axis=1, keepdims=True)) @ h
        y = np.where(s > 0, s, np.expm1(s))
    z = y / np.linalg.norm(y, axis=1, keepdims=True)
    return ((1 / (1 + np.exp(-z @ z.T)) - A) ** 2).mean(), z


def test_error_bound_holds_and_falls():
    t = np.linspace(-1, 1, 997)
    bounds = [R.bound(d) for d in (5, 7, 9, 11)]
    assert all(b < a / 20 for a, b in zip(bounds, bounds[1:])) and bounds[1] < 1.3e-6
    assert np.abs(np.polynomial.polynomial.polyval(t, R.coefficients(7)) - R.squared_sigmoid(t)).max() <= bounds[1] * 1.01


def test_moments_replace_all_pairs(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(60, 5))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z[7] = 0  # an all-zero row stays one
    df = spark.createDataFrame([(f"a{i}", z[i].tolist()) for i in range(60)], "author string, z array<double>").repartition(4)
    edges = [(f"a{i}", f"a{j}", int(rng.integers(1, 5))) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.1]
    adj = np.zeros((60, 60))
    for s, d, w in edges:
        adj[int(s[1:]), int(d[1:])] = adj[int(d[1:]), int(s[1:])] = w
    row = R.reconstruction_loss(df, spark.createDataFrame(edges, "src string, dst string, weight long"), degree=9).first()
    exact = ((1 / (1 + np.exp(-z @ z.T)) - adj) ** 2).mean()
    assert row.nodes == 60 and abs(row.mse - exact) <= row.error_bound + 1e-12
    none = R.reconstruction_loss(df.limit(0), spark.createDataFrame([], "src string, dst string, weight long")).first()
    assert (none.nodes, none.mse) == (0, None)
    with pytest.raises(ValueError):
        R.Monomials(64, 9)


def test_gradients_equal_finite_differences(graph):
    trials = [FT.Trial(hidden=4, embedding=3, seed=1, lr=0.05), FT.Trial(hidden=5, embedding=2, seed=2, lr=0.02)]
    for epoch, losses, grads, z in FT.fit_encoders(*graph, trials, 2, degree=13):
        cells = {}
        for r in grads.collect():
            cells.setdefault((r.trial, r.name), {})[r.i] = r.v
        stats = {(r.trial, r.name): r for r in FT.gradient_statistics(grads).collect()}
        vectors = {(r.trial, r.node): r.z for r in z.collect()}
        for k, t in enumerate(trials):
            loss, rows = dense(t.weights)
            assert abs(losses[k] - loss) < 1e-9
            assert np.allclose([vectors[k, n] for n in NAME], rows, atol=1e-10)
            for name in FT.NAMES:
                got = np.array([v for _, v in sorted(cells[k, name].items())])
                for i in range(0, t.weights[name].size, 1 if epoch == 0 else 5):
                    moved = {q: v.copy() for q, v in t.weights.items()}
                    moved[name].flat[i] += 1e-5
                    up, _ = dense(moved)
                    moved[name].flat[i] -= 2e-5
                    assert abs((up - dense(moved)[0]) / 2e-5 - got[i]) < 1e-8
                s = stats[k, name]
                assert s.cells == got.size and np.allclose([s["mean"], s["std"], s["norm"]], [got.mean(), got.std(ddof=1), np.linalg.norm(got)])


def test_loss_falls_and_patience_ends_a_trial(graph):
    trials = [FT.Trial(hidden=4, embedding=3, seed=1, lr=0.05, weight_decay=0.0), FT.Trial(hidden=4, embedding=3, seed=1, lr=5.0, patience=0)]
    seen = [losses for _, losses, _, _ in FT.fit_encoders(*graph, trials, 10, degree=9)]
    first = [s[0] for s in seen]
    assert len(first) == 10 and first[-1] < first[0] and sum(b < a for a, b in zip(first, first[1:])) >= 7
    assert 1 in seen[0] and 1 not in seen[-1]


def test_plan_of_the_fit_has_no_table_of_pairs(graph):
    _, _, grads, z = next(iter(FT.fit_encoders(*graph, [FT.Trial(hidden=2, embedding=2)], 1)))
    plan = grads._jdf.queryExecution().toString() + z._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_seeded_weights_are_the_column_expression(spark):
    w = N.seeded_weights([3, 5, 2], seed=9, clusters=4)
    bounds = N.weight_bounds([3, 5, 2], clusters=4)
    assert {k: np.shape(v) for k, v in w.items()} == {"W0": (3, 5), "a_self0": (5,), "a_neighs0": (5,), "W1": (5, 2), "a_self1": (2,),
                                                      "a_neighs1": (2,), "centres": (4, 2)}
    assert all(np.abs(v).max() <= bounds[k][2] for k, v in w.items()) and N.seeded_weights([3, 5, 2], seed=8)["W0"][0, 0] != w["W0"][0, 0]
    x = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "author string, x array<double>")
    table = {(r.i, r.j): r.w for r in N.weight_table(x, "W0", 5, bounds["W0"][2], seed=9).collect()}
    assert len(table) == 15 and all(abs(table[i, j] - w["W0"][i, j]) < 1e-12 for i in range(3) for j in range(5))
    draws = np.array([N.seeded_draw(1, "u", i, 0) for i in range(2000)])
    assert abs(draws.mean() - 0.5) < 0.03 and abs(draws.var() - 1 / 12) < 0.01


def test_trials_of_a_grid_are_seeded_and_different():
    grid = {"hidden": [4, 8], "embedding": [2, 3], "lr": [0.01, 0.1]}
    a, b = FT.pick_trials(grid, 5, seed=3), FT.pick_trials(grid, 5, seed=3)
    shape = lambda ts: [(t.hidden, t.embedding, t.lr) for t in ts]
    assert shape(a) == shape(b) and len(set(shape(a))) == 5 and len(FT.pick_trials(grid, 99)) == 8


def test_total_loss_is_null_with_one_cluster(spark):
    z = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "author string, z array<double>")
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, weight long")
    q = N.soft_assign(z, [[1.0, 0.0], [0.0, 1.0]])
    one = R.total_loss(z, edges, q, z.select("author", F.lit(0).alias("cluster"))).first()
    assert one.clusters == 1 and one.total is None and one.kl is not None and one.mse is not None
    two = R.total_loss(z, edges, q, N.hard_label(q)).first()
    assert abs(two.total - (two.kl + two.mse + (1 - two.silhouette))) < 1e-12


def test_search_logs_one_row_per_trial_and_epoch(spark):
    from authornet.plans import q_fit
    rows = q_fit.q_n16(spark, "/root/testdata/sf0.001").collect()
    per = {}
    for r in rows:
        per.setdefault(r.trial, []).append((r.epoch, r.loss))
    assert set(per) == {0, 1, 2, 3} and all([e for e, _ in sorted(v)] == list(range(len(v))) for v in per.values())
    assert any(sorted(v)[-1][1] < sorted(v)[0][1] for v in per.values())


def test_fit_on_the_author_graph_lowers_the_loss(spark):
    from authornet.plans import q_fit
    rows = [r.loss for r in q_fit.q_n15(spark, "/root/testdata/sf0.001").orderBy("epoch").collect()]
    assert len(rows) == q_fit.FIT_EPOCHS + 1 and rows[-1] < rows[0]
    stats = q_fit.q_n17(spark, "/root/testdata/sf0.001").collect()
    assert len(stats) == q_fit.FIT_EPOCHS * len(FT.NAMES) and all(r.norm >= abs(r["mean"]) for r in stats)


def test_clusters_of_a_fitted_encoder(spark):
    from authornet.plans import q_fit
    table, losses = q_fit.trained_authors(spark, "/root/testdata/sf0.001", epochs=3)
    assert losses[-1] < losses[0]
    rows = table.collect()
    probs = np.array([[r[f"cluster_{i}_prob"] for i in range(6)] for r in rows])
    assert len(rows) == len({r.author for r in rows}) > 0 and np.allclose(probs.sum(axis=1), 1)
    assert [r.cluster for r in rows] == probs.argmax(axis=1).tolist() and len({r.cluster for r in rows}) > 1
