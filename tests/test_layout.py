"""The neighbour embedding keeps more of the true neighbours than principal components do."""
import numpy as np

from authornet.operators import layout as L
from authornet.operators import validity as V


def kept_share(x, y, k=10):
    """Share of the k nearest rows in x that are among the k nearest in y."""
    def near(m):
        far = ((m[:, None] - m[None]) ** 2).sum(axis=2)
        np.fill_diagonal(far, np.inf)
        return np.argsort(far, axis=1, kind="stable")[:, :k]
    a, b = near(x), near(y)
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(a.tolist(), b.tolist())])


def test_grid_fields_equal_direct_sums():
    rng = np.random.default_rng(3)
    cells = rng.random((3, 16, 16))
    got = L.kernel_fields(cells, 0.3)
    at = np.stack(np.meshgrid(np.arange(16), np.arange(16), indexing="ij"), axis=-1).reshape(-1, 2) * 0.3
    near = 1 / (1 + ((at[:, None] - at[None]) ** 2).sum(axis=2))
    flat = cells.reshape(3, -1)
    want = np.stack([near @ flat[0], *[(near ** 2) @ flat[c] for c in range(3)]])
    assert np.allclose(got.reshape(4, -1), want)


def test_layout_keeps_neighbours_better_than_principal_components(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    placed = {r.vec_id: (r.y0, r.y1) for r in L.neighbour_layout(e).collect()}
    flat = {r.vec_id: (r.pc1, r.pc2) for r in V.project_2d(e).collect()}
    assert set(placed) == set(ids)
    layout, pca = (kept_share(x, np.array([m[i] for i in ids])) for m in (placed, flat))
    assert layout > 1.5 * pca and layout > 0.1, (layout, pca)


def test_layout_of_few_rows(spark):
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.y0) for r in L.neighbour_layout(two).collect()) == [(1, 0.0), (2, 0.0)]
