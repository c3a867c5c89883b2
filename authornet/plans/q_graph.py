"""Registered queries for the author graph (A11, A12, A18, J6, J7, J9,
G1-G12, S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import stats as ST
from ..sources import sinks
from . import sqltwin as S
from .authors import narrow_messages, round_doubles
from .catalog import ORACLE, register

GRAPH_SQL = S.with_ctes(*S.BASE) + """,
mem AS (SELECT DISTINCT group_name, author FROM clean WHERE author IS NOT NULL AND group_name IS NOT NULL),
nodes AS (SELECT DISTINCT author FROM mem),
pairs AS (SELECT a.author AS src, b.author AS dst, a.group_name FROM mem a JOIN mem b
          ON a.group_name = b.group_name AND a.author < b.author),
edges AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS weight FROM pairs GROUP BY src, dst),
sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst AS src, src AS dst, weight FROM edges),
stren AS (SELECT n.author, CAST(coalesce(sum(s.weight), 0) AS BIGINT) AS strength
          FROM nodes n LEFT JOIN sym s ON s.src = n.author GROUP BY n.author),
deg AS (SELECT n.author, CAST(count(s.dst) AS BIGINT) AS degree FROM nodes n LEFT JOIN sym s ON s.src = n.author GROUP BY n.author),
adjn AS (SELECT x.src, x.dst, x.a / (st.strength + 1) AS w FROM
          (SELECT src, dst, CAST(weight AS DOUBLE) AS a FROM sym UNION ALL SELECT author, author, 1.0 FROM nodes) x
          JOIN stren st ON st.author = x.src),
colsum AS (SELECT dst, sum(w) AS c FROM adjn GROUP BY dst),
tp AS (SELECT a.src, a.dst, a.w / c.c AS t FROM adjn a JOIN colsum c ON a.dst = c.dst),
t2 AS (SELECT x.src, y.dst, sum(x.t * y.t) AS t2 FROM tp x JOIN tp y ON x.dst = y.src GROUP BY x.src, y.dst),
idx AS (SELECT author, CAST(row_number() OVER (ORDER BY author) - 1 AS BIGINT) AS idx FROM nodes)
"""


def _graph(spark, sf):
    clean = narrow_messages(spark, sf)
    mem = G.memberships(clean)
    edges = G.pair_weights(G.author_pairs(mem))
    return clean, mem, edges, mem.select("author").distinct()


@register("a11_memberships", GRAPH_SQL + "SELECT group_name, author FROM mem")
def q_a11(spark, sf):
    return G.memberships(narrow_messages(spark, sf))


@register("j6_author_pairs", GRAPH_SQL + "SELECT src, dst, group_name FROM pairs")
def q_j6(spark, sf):
    return G.author_pairs(G.memberships(narrow_messages(spark, sf)))


@register("j6_author_pairs_salted", GRAPH_SQL + "SELECT src, dst, group_name FROM pairs")
def q_j6s(spark, sf):
    """Same result with a tiny block size: every group is split, as a hot
    group would be at scale."""
    return G.author_pairs(G.memberships(narrow_messages(spark, sf)), block=3)


@register("a12_pair_weights", GRAPH_SQL + "SELECT src, dst, weight FROM edges")
def q_a12(spark, sf):
    return _graph(spark, sf)[2]


@register("g1_membership_graph", GRAPH_SQL + "SELECT src, dst, weight FROM edges")
def q_g1(spark, sf):
    return G.membership_graph(narrow_messages(spark, sf))


@register("g2_symmetric", GRAPH_SQL + "SELECT src, dst, weight FROM sym")
def q_g2(spark, sf):
    return G.symmetric(_graph(spark, sf)[2])


@register("g3_normalize_adj", S.rounded(["src", "dst", "w"], {"w"}, GRAPH_SQL + "SELECT src, dst, w FROM adjn"))
def q_g3(spark, sf):
    _, mem, edges, _ = _graph(spark, sf)
    return round_doubles(G.normalize_adj(edges, mem))


@register("g4_graph_size", GRAPH_SQL + "SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS edges")
def q_g4(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return G.graph_size(edges, nodes)


@register("g5_degree", GRAPH_SQL + "SELECT author, degree FROM deg")
def q_g5(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return G.degree(edges, nodes)


@register("g5_degree_stats", GRAPH_SQL + "SELECT CAST(floor(avg(degree)) AS BIGINT) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM deg")
def q_g5s(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return G.degree_stats(G.degree(edges, nodes))


@register("g6_strength", GRAPH_SQL + "SELECT author, strength FROM stren")
def q_g6(spark, sf):
    mem = G.memberships(narrow_messages(spark, sf))
    return G.strength(mem).select("author", F.col("strength").cast("bigint").alias("strength"))


@register("g7_degree_centrality", S.rounded(["author", "degree", "degree_centrality"], {"degree_centrality"},
                                            GRAPH_SQL + "SELECT author, degree, degree / ((SELECT count(*) FROM nodes) - 1) AS degree_centrality FROM deg"))
def q_g7(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return round_doubles(G.degree_centrality(G.degree(edges, nodes), nodes))


@register("g8_degree_histogram", GRAPH_SQL + """, st AS (SELECT min(degree) AS lo, max(degree) AS hi FROM deg),
b AS (SELECT CAST(CASE WHEN st.hi = st.lo THEN 0 ELSE least(floor((d.degree - st.lo) / ((st.hi - st.lo) / 20.0)), 19) END AS BIGINT) AS bin
      FROM deg d, st)
SELECT r.range AS bin, CAST(count(b.bin) AS BIGINT) AS count FROM range(20) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range""")
def q_g8(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return ST.histogram(G.degree(edges, nodes), "degree", bins=20).select("bin", "count")


@register("g9_transition", S.rounded(["src", "dst", "m"], {"m"}, GRAPH_SQL + """
SELECT tp.src, tp.dst, (tp.t + coalesce(t2.t2, 0)) / 2 AS m FROM tp LEFT JOIN t2 ON tp.src = t2.src AND tp.dst = t2.dst"""))
def q_g9(spark, sf):
    _, mem, edges, _ = _graph(spark, sf)
    return round_doubles(G.transition(edges, mem, t=2))


@register("g9_transition_hot_authors", S.rounded(["src", "dst", "m"], {"m"}, GRAPH_SQL + """
SELECT tp.src, tp.dst, (tp.t + coalesce(t2.t2, 0)) / 2 AS m FROM tp LEFT JOIN t2 ON tp.src = t2.src AND tp.dst = t2.dst"""))
def q_g9h(spark, sf):
    """Same matrix with every author in more than one group taken through
    the hot-author path (as authors active in very many groups would be)."""
    _, mem, edges, _ = _graph(spark, sf)
    return round_doubles(G.transition(edges, mem, t=2, hot_groups=1))


@register("g9_transition_t3", S.rounded(["src", "dst", "m"], {"m"}, GRAPH_SQL + """,
t3 AS (SELECT x.src, y.dst, sum(x.t2 * y.t) AS t3 FROM t2 x JOIN tp y ON x.dst = y.src GROUP BY x.src, y.dst)
SELECT tp.src, tp.dst, (tp.t + coalesce(t2.t2, 0) + coalesce(t3.t3, 0)) / 3 AS m FROM tp
LEFT JOIN t2 ON tp.src = t2.src AND tp.dst = t2.dst LEFT JOIN t3 ON tp.src = t3.src AND tp.dst = t3.dst"""))
def q_g9t3(spark, sf):
    _, mem, edges, _ = _graph(spark, sf)
    return round_doubles(G.transition(edges, mem, t=3))


@register("g10_closeness", S.rounded(["author", "closeness_centrality"], {"closeness_centrality"}, GRAPH_SQL + """,
bfs AS (
  WITH RECURSIVE walk(s, a, d) AS (
    SELECT author, author, 0 FROM nodes
    UNION
    SELECT w.s, y.dst, w.d + 1 FROM walk w JOIN sym y ON w.a = y.src WHERE w.d < 12)
  SELECT s, a, min(d) AS d FROM walk GROUP BY s, a),
agg AS (SELECT s, count(*) AS r, sum(d) AS tot FROM bfs WHERE d > 0 GROUP BY s)
SELECT n.author, CASE WHEN agg.tot > 0 THEN (agg.r / ((SELECT count(*) FROM nodes) - 1)) * (agg.r / agg.tot) ELSE 0.0 END AS closeness_centrality
FROM nodes n LEFT JOIN agg ON agg.s = n.author"""))
def q_g10(spark, sf):
    _, mem, edges, nodes = _graph(spark, sf)
    return round_doubles(G.closeness(edges, nodes, mem=mem))


@register("g10_closeness_batches", ORACLE["g10_closeness"])
def q_g10b(spark, sf):
    """The same with 100 sources at a time."""
    _, mem, edges, nodes = _graph(spark, sf)
    return round_doubles(G.closeness(edges, nodes, mem=mem, at_once=100))


G12_STEPS = 30


@register("g12_eigenvector", S.rounded(["author", "eigenvector_centrality"], {"eigenvector_centrality"}, GRAPH_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
stepm AS (SELECT src, dst FROM sym UNION ALL SELECT author, author FROM nodes),
ev AS (SELECT 0 AS it, author, CAST(1 AS DOUBLE) AS x FROM nodes
  UNION ALL SELECT e.it + 1, m.dst, sum(e.x) FROM ev e JOIN stepm m ON m.src = e.author WHERE e.it < {G12_STEPS} GROUP BY e.it + 1, m.dst)
SELECT author, x / sqrt(sum(x * x) OVER ()) AS eigenvector_centrality FROM ev WHERE it = {G12_STEPS}"""))
def q_g12(spark, sf):
    """A fixed number of power steps (the twin takes as many)."""
    _, mem, edges, nodes = _graph(spark, sf)
    return round_doubles(G.eigenvector(edges, nodes, iters=G12_STEPS, fixed=True))


@register("a18_node_index", GRAPH_SQL + "SELECT author, idx FROM idx")
def q_a18(spark, sf):
    return G.node_index(_graph(spark, sf)[3])


@register("s5_edge_list", GRAPH_SQL + """SELECT a.idx AS source, b.idx AS target, s.weight AS Weight
FROM sym s JOIN idx a ON a.author = s.src JOIN idx b ON b.author = s.dst""")
def q_s5(spark, sf):
    _, _, edges, nodes = _graph(spark, sf)
    return sinks.edge_list(edges, G.node_index(nodes))


@register("j7_lookup", GRAPH_SQL + """SELECT c.author, CAST(count(*) AS BIGINT) AS total_message_count, d.degree
FROM clean c JOIN deg d ON d.author = c.author GROUP BY c.author, d.degree""")
def q_j7(spark, sf):
    clean, _, edges, nodes = _graph(spark, sf)
    counts = A.message_counts(clean, ["author"]).select("author", "total_message_count")
    return G.lookup(counts, G.degree(edges, nodes), "author")


@register("j9_missing_keys", GRAPH_SQL + "SELECT author FROM nodes WHERE author NOT IN (SELECT author FROM clean WHERE author IS NOT NULL AND forwarded_message > 0)")
def q_j9(spark, sf):
    """Authors of the graph that the table of forwarders lacks."""
    clean, _, _, nodes = _graph(spark, sf)
    return G.missing_keys(nodes, A.message_counts(clean.filter("forwarded_message > 0"), ["author"]))
