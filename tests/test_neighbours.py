"""Exact nearest neighbours, resampling and the sliced silhouette against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from authornet.operators import neighbours as NB
from authornet.operators import validity as V

RNG = np.random.default_rng(4)


def clustered(n=300, d=6):
    """Points around a few centres, a third of them in one spot, with exact copies (ties)."""
    centres = RNG.normal(size=(6, d)) * 4
    pick = np.where(RNG.random(n) < 0.34, 0, RNG.integers(1, 6, n))
    x = centres[pick] + RNG.normal(size=(n, d)) * np.where(pick == 0, 0.05, 0.8)[:, None]
    x[5:20] = x[4]
    return x, pick


def brute(x, k, same=None):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = {}
    for i in range(len(x)):
        ok = [j for j in range(len(x)) if j != i and (same is None or same[i] == same[j])]
        out[i] = [(j, far[i, j]) for j in sorted(ok, key=lambda j: (far[i, j], j))[:k]]
    return out


def frame(spark, x, label):
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(len(x))] + [(None, [0.0] * x.shape[1], 0), (9999, None, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize("pivots, block, by", [(8, 16, None), (1, 7, None), (64, 256, None), (8, 16, "label")])
def test_neighbours_equal_brute_force(spark, pivots, block, by):
    x, label = clustered()
    near, work = NB.nearest(frame(spark, x, label), "vec_id", "embedding", 4, by, pivots, block)
    got = {}
    for r in near.collect():
        got.setdefault(r.key, {})[r.nth] = (r.neighbour, r.distance)
    want = brute(x, 4, label if by else None)
    assert set(got) == {i for i, v in want.items() if v}
    for i, v in want.items():
        found = [got[i][n] for n in sorted(got.get(i, {}))]
        assert [j for j, _ in found] == [j for j, _ in v] and np.allclose([d for _, d in found], [d for _, d in v])
    cost = work.first()
    assert cost.distances <= cost.all_pairs and cost.block_pairs > 0
    if (pivots, by) == (8, None):
        assert cost.distances < 0.7 * cost.all_pairs  # the bounds prune


def test_few_rows_and_none(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0]])
    near, _ = NB.nearest(frame(spark, x, [0, 1]), "vec_id", "embedding", 3)
    assert sorted((r.key, r.nth, r.neighbour) for r in near.collect()) == [(0, 1, 1), (1, 1, 0)]
    none, work = NB.nearest(frame(spark, x, [0, 1]).filter("vec_id > 99999"), "vec_id", "embedding", 3)
    assert none.count() == 0 and work.first().distances == 0


def test_smote_balances_between_neighbours(spark):
    x, label = clustered(200)
    label[:1] = 77  # a class of one row
    made = NB.smote(frame(spark, x, label), "vec_id", "embedding", "label", k=3, pivots=8, block=16).collect()
    sizes = {c: int((label == c).sum()) for c in set(label.tolist())}
    counts = {c: sum(r.label == c for r in made) for c in sizes}
    assert all(counts[c] + n == max(sizes.values()) for c, n in sizes.items())
    near = brute(x, 3, label)
    for r in made:
        allowed = [j for j, _ in near[r.base]] or [r.base]
        assert r.neighbour in allowed and 0 <= r.gap < 1 and label[r.base] == r.label
        assert np.allclose(r.x, x[r.base] + r.gap * (x[r.neighbour] - x[r.base]))
    assert len({(r.base, r.nth) for r in made}) == len(made)


def test_edited_neighbours_by_hand(spark):
    x, label = clustered(150)
    rows = {r.key: r for r in NB.edited(frame(spark, x, label), "vec_id", "embedding", "label", pivots=8, block=16).collect()}
    for i, v in brute(x, 3).items():
        theirs = [int(label[j]) for j, _ in v]
        most = min(set(theirs), key=lambda c: (-theirs.count(c), c))
        assert (rows[i].agree, rows[i].kept, rows[i].kept_by_most) == (theirs.count(label[i]), all(c == label[i] for c in theirs), most == label[i])
    both = NB.smote_enn(frame(spark, x, label), "vec_id", "embedding", "label")
    kept = both.collect()
    assert {r.key for r in kept if "#" not in r.key} <= {str(i) for i in range(150)} and any("#" in r.key for r in kept)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_sent_once_per_run_of_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(NB, "PART_ROWS", 50)
    x, label = np.float32(RNG.normal(size=(240, 16))).astype(float), np.zeros(240, int)  # nothing to prune
    df = frame(spark, x, label).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    blocks, centres = NB.blocks_of(df, "vec_id", "embedding", None, 4, 8)
    summary = NB._Summary(blocks, centres, 1 << 20)
    routes = NB.block_routes(blocks, centres, 3, summary)
    assert summary.parts == 4 and routes.count() <= 2 * 4 * blocks.count()  # was a row of vectors for each of the 30 x 30 pairs
    assert routes.agg(F.sum("pairs")).first()[0] == blocks.count() ** 2
    near, _ = NB.nearest(df, "vec_id", "embedding", 3, None, 4, 8)
    got = {(r.key, r.nth): r.neighbour for r in near.collect()}
    assert got == {(i, n + 1): j for i, v in brute(x, 3).items() for n, (j, _) in enumerate(v)}


def test_sliced_silhouette_joins_no_table_of_points(spark):
    x, label = clustered(60)
    out = V.silhouette_sliced(frame(spark, x, label))
    assert "Join" not in out._jdf.queryExecution().toString()  # points x clusters rows, a side of a broadcast, before
    assert abs(out.first().silhouette - exact_silhouette(x, label)) <= out.first().error


def exact_silhouette(x, label):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(x)):
        own = label == label[i]
        a = far[i, own].sum() / max(own.sum() - 1, 1)
        b = min(far[i, label == c].mean() for c in set(label.tolist()) if c != label[i])
        s.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    return float(np.mean(s))


def test_sliced_silhouette_holds_the_exact_one(spark):
    x, label = clustered(240)
    row = V.silhouette_sliced(frame(spark, x, label)).first()
    assert abs(row.silhouette - exact_silhouette(x, label)) <= row.error < 0.2
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v, lab = np.array([r.embedding for r in e.collect()], dtype=float), np.array([r.label for r in e.collect()])
    row = V.silhouette_sliced(e).first()
    assert abs(row.silhouette - exact_silhouette(v, lab)) <= row.error < 0.06


def test_sliced_totals_are_exact(spark):
    x, label = clustered(80)
    u = V.projections(6, 8)
    p = x @ u.T
    for r in V.sliced_totals(frame(spark, x, label), slices=8).collect():
        assert abs(r.total - np.abs(p[r.key, r.slice] - p[label == r.cluster, r.slice]).sum()) < 1e-9
    one = V.silhouette_sliced(frame(spark, x, np.zeros(80, int)).filter("vec_id < 80")).first()
    assert one.silhouette is None


def test_more_clusters_than_one_row_holds(spark, monkeypatch):
    x, label = clustered(200)
    label[:20] = np.arange(100, 120)
    df = frame(spark, x, label).filter("vec_id < 200 AND embedding IS NOT NULL")
    whole = (V.silhouette(df).first()[0], V.davies_bouldin(df).first()[0])
    monkeypatch.setattr(V, "MAX_CLUSTERS", 4)
    assert np.allclose((V.silhouette(df).first()[0], V.davies_bouldin(df).first()[0]), whole)
