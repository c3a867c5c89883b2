"""Graph operators against dense NumPy on small graphs."""
import numpy as np
from pyspark.sql import functions as F

from authornet.operators import graph as G

MEM = [("g", "1"), ("g", "2"), ("g", "3"), ("h", "1"), ("h", "2"), ("k", "4"), ("m", "3"), ("m", "5"),
       ("big", "1"), ("big", "5"), ("big", "6"), ("big", "7")]


def mem_df(spark, rows=MEM):
    return spark.createDataFrame(rows, "group_name string, author string")


def dense(rows=MEM):
    authors = sorted({a for _, a in rows})
    ix = {a: i for i, a in enumerate(authors)}
    groups = {}
    for g, a in rows:
        groups.setdefault(g, set()).add(a)
    A = np.zeros((len(authors), len(authors)))
    for members in groups.values():
        for a in members:
            for b in members:
                if a != b:
                    A[ix[a], ix[b]] += 1
    return authors, ix, A


def test_toy_edges(spark):
    rows = [("g", "1"), ("g", "2"), ("g", "3"), ("h", "1"), ("h", "2")]
    e = G.pair_weights(G.author_pairs(mem_df(spark, rows)))
    assert sorted(tuple(r) for r in e.collect()) == [("1", "2", 2), ("1", "3", 1), ("2", "3", 1)]


def test_salted_pairs_equal_plain(spark):
    m = mem_df(spark)
    a = sorted(tuple(r) for r in G.author_pairs(m).collect())
    b = sorted(tuple(r) for r in G.author_pairs(m, block=1).collect())
    c = sorted(tuple(r) for r in G.author_pairs(m, block=2).collect())
    assert a == b == c


def test_degree_strength_and_size(spark):
    m = mem_df(spark)
    authors, ix, A = dense()
    e = G.pair_weights(G.author_pairs(m))
    nodes = m.select("author").distinct()
    deg = {r.author: r.degree for r in G.degree(e, nodes).collect()}
    st = {r.author: r.strength for r in G.strength(m).collect()}
    for a in authors:
        assert deg[a] == int((A[ix[a]] > 0).sum())
        assert st[a] == A[ix[a]].sum()
    assert sum(deg.values()) == 2 * e.count()
    size = G.graph_size(e, nodes).first()
    assert (size.nodes, size.edges) == (len(authors), int((A > 0).sum() // 2))


def test_transition_matches_dense(spark):
    m = mem_df(spark)
    authors, ix, A = dense()
    e = G.pair_weights(G.author_pairs(m))
    adj = A + np.eye(len(authors))
    adj_norm = adj / adj.sum(axis=1, keepdims=True)
    T = adj_norm / adj_norm.sum(axis=0, keepdims=True)
    for t, hot in ((2, 1000), (2, 1), (2, 0), (3, 1000)):
        M = sum(np.linalg.matrix_power(T, i) for i in range(1, t + 1)) / t
        got = G.transition(e, m, t=t, hot_groups=hot).collect()
        assert len(got) == int((adj > 0).sum())
        for r in got:
            assert abs(r.m - M[ix[r.src], ix[r.dst]]) < 1e-12, (t, hot, r)
    # normalised adjacency rows sum to 1
    rows = G.normalize_adj(e, m).groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in rows)


def test_eigenvector_matches_power_iteration(spark):
    m = mem_df(spark)
    authors, ix, A = dense()
    e = G.pair_weights(G.author_pairs(m))
    nodes = m.select("author").distinct()
    for weighted in (False, True):
        W = A if weighted else (A > 0).astype(float)
        x = np.ones(len(authors)) / len(authors)
        for _ in range(100):
            last = x
            x = last + W @ last
            x = x / np.linalg.norm(x)
            if np.abs(x - last).sum() < len(authors) * 1e-6:
                break
        got = {r.author: r.eigenvector_centrality for r in G.eigenvector(e, nodes, m, weighted=weighted).collect()}
        for a in authors:
            assert abs(got[a] - x[ix[a]]) < 1e-9


def test_closeness_matches_bfs(spark):
    m = mem_df(spark)
    authors, ix, A = dense()
    e = G.pair_weights(G.author_pairs(m))
    nodes = m.select("author").distinct()
    n = len(authors)
    expect = {}
    for a in authors:
        dist = {a: 0}
        frontier = [a]
        while frontier:
            nxt = []
            for u in frontier:
                for v in authors:
                    if A[ix[u], ix[v]] > 0 and v not in dist:
                        dist[v] = dist[u] + 1
                        nxt.append(v)
            frontier = nxt
        r, tot = len(dist) - 1, sum(dist.values())
        expect[a] = (r / (n - 1)) * (r / tot) if tot > 0 else 0.0
    for via in (None, m):
        got = {r.author: r.closeness_centrality for r in G.closeness(e, nodes, mem=via).collect()}
        for a in authors:
            assert abs(got[a] - expect[a]) < 1e-12


def test_node_index_dense_sorted(spark):
    df = spark.createDataFrame([(a,) for a in ["d", "a", "c", "b", "e"]], "author string").repartition(3)
    got = {r.author: r.idx for r in G.node_index(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}


def test_betweenness_matches_brandes(spark):
    m = mem_df(spark)
    authors, ix, A = dense()
    e = G.pair_weights(G.author_pairs(m))
    nodes = m.select("author").distinct()
    n = len(authors)
    bc = {a: 0.0 for a in authors}
    for s in authors:
        stack, pred, sigma, dist = [], {w: [] for w in authors}, dict.fromkeys(authors, 0.0), {}
        sigma[s], dist[s] = 1.0, 0
        queue = [s]
        while queue:
            v = queue.pop(0)
            stack.append(v)
            for w in authors:
                if A[ix[v], ix[w]] > 0:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
                        pred[w].append(v)
        delta = dict.fromkeys(authors, 0.0)
        while stack:
            w = stack.pop()
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    got = {r.author: r.betweenness_centrality for r in G.betweenness(e, nodes).collect()}
    for a in authors:
        assert abs(got[a] - bc[a] / ((n - 1) * (n - 2))) < 1e-12
