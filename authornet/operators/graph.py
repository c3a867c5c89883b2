"""Author co-membership graph.

Two authors are linked when they wrote to the same group; the weight is
the number of groups they share.  With the author x group incidence ``P``
(one row per distinct membership), the weighted adjacency is
``A = P Pᵀ - diag(m)`` where ``m`` is the number of groups of each author.
Quantities that only need products with ``A`` (strength, row/column
normalisers, the masked second power of the transition matrix, power
iteration) are computed from ``P`` directly, so they never build a pair or
wedge table.  Only the edge list itself (whose size *is* the output) is
built from pairs, and its self-join is salted so that a hot group is spread
over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Members of one group handled per pair-block (bounds the work of a task
# to BLOCK^2 pairs).
BLOCK = 2048


# --- memberships and edges ---------------------------------------------------------

def memberships(messages: DataFrame, null_author: str = "drop", author: str = "author",
                group: str = "group_name") -> DataFrame:
    """Distinct (group, author) over all messages (own and forwarded).
    ``null_author='node'`` keeps missing authors as one node named 'nan'."""
    a = F.col(author)
    if null_author == "node":
        a = F.coalesce(a, F.lit("nan"))
    df = messages.select(F.col(group).alias("group_name"), a.alias("author"))
    df = df.filter(F.col("author").isNotNull() & F.col("group_name").isNotNull())
    return df.distinct()


def nodes(messages: DataFrame, null_author: str = "drop") -> DataFrame:
    """Every author that appears (isolated ones included)."""
    return memberships(messages, null_author).select("author").distinct()


def group_sizes(mem: DataFrame) -> DataFrame:
    return mem.groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))


def author_pairs(mem: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (src, dst, group_name) per pair of authors sharing a
    group, ``src < dst``.  Groups larger than ``block`` are split into
    hash blocks and joined block-pair by block-pair, so no task holds more
    than ``block``² pairs however skewed the group sizes are."""
    sizes = group_sizes(mem).filter(F.col("n") >= 2)
    m = (mem.join(sizes, "group_name")  # computed side: AQE broadcasts it at run time when small
         .withColumn("nb", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("int"))
         .withColumn("b", F.pmod(F.xxhash64("author"), F.col("nb")).cast("int")))
    left = m.select("group_name", "author", F.col("b").alias("bi"),
                    F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("bj"))
    right = m.select("group_name", F.col("author").alias("author2"),
                     F.explode(F.sequence(F.lit(0), F.col("b"))).alias("bi"), F.col("b").alias("bj"))
    pairs = left.join(right, ["group_name", "bi", "bj"])
    pairs = pairs.filter((F.col("bi") < F.col("bj")) | (F.col("author") < F.col("author2")))
    return pairs.select(F.least("author", "author2").alias("src"), F.greatest("author", "author2").alias("dst"),
                        "group_name")


def pair_weights(pairs: DataFrame) -> DataFrame:
    """weight = number of shared groups (partial aggregation first)."""
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def membership_graph(messages: DataFrame, null_author: str = "drop", block: int = BLOCK) -> DataFrame:
    """G1: weighted undirected edges (src < dst, weight)."""
    return pair_weights(author_pairs(memberships(messages, null_author), block))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    fwd = edges.select("src", "dst", "weight")
    return fwd.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


# --- factored quantities -------------------------------------------------------------

def strength(mem: DataFrame) -> DataFrame:
    """Weighted degree s_i = sum over i's groups of (|g| - 1), plus the
    group count m_i; from memberships alone, no pair table."""
    sizes = group_sizes(mem)
    return (mem.join(sizes, "group_name")
            .groupBy("author").agg(F.sum(F.col("n") - 1).alias("strength"),
                                   F.count(F.lit(1)).alias("groups")))


def normalize_adj(edges: DataFrame, mem: DataFrame) -> DataFrame:
    """Row-L1 normalisation of A + I as a long table (src, dst, w),
    self-loops included; the row sums come from the factored strength."""
    s = strength(mem).select("author", (F.col("strength") + 1).alias("rowsum"))
    both = symmetric(edges).select("src", "dst", F.col("weight").cast("double").alias("a"))
    loops = s.select(F.col("author").alias("src"), F.col("author").alias("dst"), F.lit(1.0).alias("a"))
    return (both.unionByName(loops)
            .join(s.withColumnRenamed("author", "src"), "src")
            .select("src", "dst", (F.col("a") / F.col("rowsum")).alias("w")))


def _column_norms(mem: DataFrame) -> DataFrame:
    """Per author j: s_j, m_j and the column sum C_j of the row-normalised
    A + I, C_j = sum_{g of j} R_g + (1 - m_j)/(s_j + 1), R_g = sum_{k in g} 1/(s_k + 1)."""
    st = strength(mem)
    inv = mem.join(st, "author").select("group_name", "author", (1.0 / (F.col("strength") + 1)).alias("inv"))
    r = inv.groupBy("group_name").agg(F.sum("inv").alias("R"))
    c = mem.join(r, "group_name").groupBy("author").agg(F.sum("R").alias("RS"))
    return (st.join(c, "author")
            .select("author", "strength", "groups",
                    (F.col("RS") + (1 - F.col("groups")) / (F.col("strength") + 1)).alias("C")))


def transition(edges: DataFrame, mem: DataFrame, t: int = 2, hot_groups: int = 1000) -> DataFrame:
    """M = mean of T^1..T^t, T = column-L1 normalisation of the
    row-normalised A + I, read only on the support of A + I (the only
    entries the attention layer uses).  Returns (src, dst, m).

    t = 2 is computed in factored form: with W = diag(1/((s+1) C)) and
    A + I = P Pᵀ + diag(1 - m),
    ((A+I) W (A+I))_ij = (P Q Pᵀ)_ij + (P Pᵀ)_ij (w_i e_i + w_j e_j) + δ_ij e_i² w_i
    with e = 1 - m and Q = Pᵀ W P (group x group, built from each author's
    own groups).  Larger t goes through group space too (``_transition_powers``);
    no power is ever built over all author pairs.

    The memberships and edges are read many times below, so they are
    checkpointed once (reliably, in the shared checkpoint folder)."""
    mem, edges = cut_lineage(mem), cut_lineage(edges)
    norms = cut_lineage(_column_norms(mem))
    s_i = norms.select(F.col("author").alias("src"), (F.col("strength") + 1).alias("rs"))
    c_j = norms.select(F.col("author").alias("dst"), F.col("C").alias("C"))
    # support of A + I with (A+I)_ij = (P Pᵀ)_ij - m_i δ_ij + δ_ij
    both = symmetric(edges).select("src", "dst", F.col("weight").cast("double").alias("a"))
    loops = norms.select(F.col("author").alias("src"), F.col("author").alias("dst"), F.lit(1.0).alias("a"))
    sup = both.unionByName(loops)
    t1 = (sup.join(s_i, "src").join(c_j, "dst")
          .select("src", "dst", (F.col("a") / (F.col("rs") * F.col("C"))).alias("t1")))
    if t == 1:
        return t1.select("src", "dst", F.col("t1").alias("m"))
    if t != 2:
        return _transition_powers(sup, mem, norms, t)
    w = norms.select("author", (1.0 / ((F.col("strength") + 1) * F.col("C"))).alias("w"),
                     (1 - F.col("groups")).alias("e"), "groups")
    sup_pairs = sup.select(F.col("src").alias("i"), F.col("dst").alias("j"), "a")
    # Authors in more than `hot_groups` groups would make Q quadratic in their
    # group count; they contribute through their adjacency columns instead:
    # H_ij = sum over hot l of w_l c_il c_jl, c = P Pᵀ (rows <= support x hot).
    normal = w.filter(F.col("groups") <= hot_groups).select("author")
    mem_n = mem.join(normal, "author")
    # Q_gh = sum over ordinary authors l in g and h of w_l (pairs of l's own groups)
    pw = mem_n.join(w.select("author", "w"), "author")
    q = (pw.alias("x").join(mem_n.alias("y"), F.col("x.author") == F.col("y.author"))
         .groupBy(F.col("x.group_name").alias("g"), F.col("y.group_name").alias("h"))
         .agg(F.sum("x.w").alias("q")))
    # U_ih = sum over i's groups g of Q_gh
    u = (mem.join(q, mem.group_name == q.g).groupBy(mem.author.alias("i"), q.h.alias("h"))
         .agg(F.sum("q").alias("u")))
    # (P Q Pᵀ)_ij on the support = sum over j's groups h of U_ih
    pqp = (sup_pairs.join(mem.select(F.col("author").alias("j"), F.col("group_name").alias("h")), "j")
           .join(u, ["i", "h"]).groupBy("i", "j").agg(F.sum("u").alias("pqp")))
    hot = w.filter(F.col("groups") > hot_groups).select(F.col("author").alias("l"), F.col("w").alias("wl"), "groups")
    if hot.limit(1).count() > 0:
        c_hot = (both.join(hot, both.dst == hot.l).select(F.col("src").alias("x"), "l", F.col("a").alias("c"), "wl")
                 .unionByName(hot.select(F.col("l").alias("x"), "l", F.col("groups").cast("double").alias("c"), "wl")))
        c_hot = cut_lineage(c_hot)
        ci = c_hot.select(F.col("x").alias("i"), "l", F.col("c").alias("ci"), "wl")
        cj = c_hot.select(F.col("x").alias("j"), "l", F.col("c").alias("cj"))
        h_part = (sup_pairs.select("i", "j").join(ci, "i").join(cj, ["j", "l"])
                  .groupBy("i", "j").agg(F.sum(F.col("wl") * F.col("ci") * F.col("cj")).alias("hp")))
        pqp = (pqp.join(h_part, ["i", "j"], "full")
               .select("i", "j", (F.coalesce("pqp", F.lit(0.0)) + F.coalesce("hp", F.lit(0.0))).alias("pqp")))
    wi = w.select(F.col("author").alias("i"), F.col("w").alias("wi"), F.col("e").alias("ei"))
    wj = w.select(F.col("author").alias("j"), F.col("w").alias("wj"), F.col("e").alias("ej"))
    # (P Pᵀ)_ij = a_ij off the diagonal, m_i on it
    ppt = F.when(F.col("i") == F.col("j"), 1 - F.col("ei")).otherwise(F.col("a"))
    diag = F.when(F.col("i") == F.col("j"), F.col("ei") * F.col("ei") * F.col("wi")).otherwise(F.lit(0.0))
    sq = (sup_pairs.join(pqp, ["i", "j"], "left").join(wi, "i").join(wj, "j")
          .select("i", "j", (F.coalesce("pqp", F.lit(0.0)) + ppt * (F.col("wi") * F.col("ei") + F.col("wj") * F.col("ej"))
                              + diag).alias("aw")))
    t2 = (sq.join(s_i.withColumnRenamed("src", "i"), "i").join(c_j.withColumnRenamed("dst", "j"), "j")
          .select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("aw") / (F.col("rs") * F.col("C"))).alias("t2")))
    return (t1.join(t2, ["src", "dst"], "left")
            .select("src", "dst", ((F.col("t1") + F.coalesce("t2", F.lit(0.0))) / 2).alias("m")))


def _transition_powers(sup: DataFrame, mem: DataFrame, norms: DataFrame, t: int) -> DataFrame:
    """Mean of T^1..T^t on the support of A + I, with the powers kept as
    author x group tables.  With B = A + I = P Pᵀ + E, E = diag(1 - m), and
    Y_k = B (W B)^(k-1):

      Y_k = sum over r = 1..k of U_r Pᵀ (W E)^(k-r) + E (W E)^(k-1)
      U_1 = P,  U_k = sum over j = 0..k-2 of U_(k-1-j) Q_j + E (W E)^(k-2) W P,
      Q_j = Pᵀ (W E)^j W P  (group x group, from each author's own groups)

    and T^k_ij = Y_k(i, j) / (rs_i C_j).  U_r is joined to the support's
    pairs through the target's groups, so only entries on the support are summed."""
    d = norms.select("author", (1.0 / ((F.col("strength") + 1) * F.col("C"))).alias("w"),
                     (1 - F.col("groups")).cast("double").alias("e"), (F.col("strength") + 1).alias("rs"), "C")
    d = cut_lineage(d.withColumn("we", F.col("w") * F.col("e")))
    own = mem.join(d, "author")
    q = (own.select("author", F.col("group_name").alias("g"), "w", "we").join(mem.withColumnRenamed("group_name", "h"), "author")
         .groupBy("g", "h").agg(*[F.sum(F.col("w") * F.pow("we", F.lit(j))).alias(f"q{j}") for j in range(t - 1)]))
    q = cut_lineage(q)
    u = [mem.select(F.col("author").alias("i"), F.col("group_name").alias("h"), F.lit(1.0).alias("u"))]
    for k in range(2, t + 1):
        parts = own.select(F.col("author").alias("i"), F.col("group_name").alias("h"),
                           (F.col("e") * F.pow("we", F.lit(k - 2)) * F.col("w")).alias("u"))
        for j in range(k - 1):
            step = q.select("g", F.col("h").alias("h2"), F.col(f"q{j}").alias("q"))
            parts = parts.unionByName(u[k - 2 - j].join(step, F.col("h") == F.col("g"))
                                      .select("i", F.col("h2").alias("h"), (F.col("u") * F.col("q")).alias("u")))
        u.append(cut_lineage(parts.groupBy("i", "h").agg(F.sum("u").alias("u"))))
    every = None
    for r, table in enumerate(u, 1):
        part = table.withColumn("r", F.lit(r))
        every = part if every is None else every.unionByName(part)
    pairs = sup.select(F.col("src").alias("i"), F.col("dst").alias("j"))
    seen = (pairs.join(mem.select(F.col("author").alias("j"), F.col("group_name").alias("h")), "j").join(every, ["i", "h"])
            .groupBy("i", "j").agg(*[F.sum(F.when(F.col("r") == r, F.col("u"))).alias(f"p{r}") for r in range(1, t + 1)]))
    di = d.select(F.col("author").alias("i"), F.col("rs").alias("rs"), F.col("e").alias("ei"), F.col("we").alias("wei"))
    dj = d.select(F.col("author").alias("j"), "C", F.col("we").alias("wej"))
    total = F.lit(0.0)
    for k in range(1, t + 1):
        for r in range(1, k + 1):
            total = total + F.coalesce(F.col(f"p{r}"), F.lit(0.0)) * F.pow("wej", F.lit(k - r))
        total = total + F.when(F.col("i") == F.col("j"), F.col("ei") * F.pow("wei", F.lit(k - 1))).otherwise(F.lit(0.0))
    return (pairs.join(seen, ["i", "j"], "left").join(di, "i").join(dj, "j")
            .select(F.col("i").alias("src"), F.col("j").alias("dst"), (total / (F.col("rs") * F.col("C")) / F.lit(float(t))).alias("m")))


# --- counts, degrees, centralities -----------------------------------------------------

def graph_size(edges: DataFrame, node_df: DataFrame) -> DataFrame:
    """Node and edge counts (isolated nodes included) in one aggregate."""
    both = node_df.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("edges"))


def degree(edges: DataFrame, node_df: DataFrame) -> DataFrame:
    """Unweighted neighbour count per author, 0 for isolated authors."""
    d = symmetric(edges).groupBy(F.col("src").alias("author")).agg(F.count(F.lit(1)).alias("degree"))
    return node_df.join(d, "author", "left").select("author", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_stats(deg: DataFrame) -> DataFrame:
    """Average (truncated), min and max degree."""
    return deg.agg(F.floor(F.avg("degree")).cast("bigint").alias("avg_degree"),
                   F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def degree_centrality(deg: DataFrame, node_df: DataFrame | None = None) -> DataFrame:
    """Degree / (N - 1); N is counted on the node table where it is given,
    so the pairs are built once."""
    n = (node_df if node_df is not None else deg).count()  # one scalar
    return deg.select("author", "degree",
                      (F.col("degree") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)).alias("degree_centrality"))


def node_index(node_df: DataFrame, key: str = "author") -> DataFrame:
    """Dense 0-based index in sorted key order, computed with a
    range-partitioned sort and per-partition offsets (no single-partition
    window)."""
    from .clean import row_positions
    return row_positions(node_df.select(key), key, out="_pos").select(key, (F.col("_pos") - 1).alias("idx"))


def lookup(df: DataFrame, table: DataFrame, key: str = "author") -> DataFrame:
    """J7."""
    return df.join(table, key, "left")


def missing_keys(a: DataFrame, b: DataFrame, key: str = "author") -> DataFrame:
    """Keys of ``a`` absent from ``b`` (expected empty)."""
    return a.select(key).join(b.select(key), key, "left_anti")


def eigenvector(edges: DataFrame, node_df: DataFrame, mem: DataFrame | None = None, weighted: bool = False,
                iters: int = 100, tol: float = 1e-6, checkpoint_every: int = 5, fixed: bool = False) -> DataFrame:
    """Power iteration with networkx's convention: iterate on A + I,
    L2-normalise, stop when the L1 change is below N * tol.  Unweighted
    (the networkx default) multiplies through the edge table; weighted
    uses the factored form A v = P (Pᵀ v) - m ∘ v on the memberships, so it
    needs no pair table at all.  ``fixed`` takes exactly ``iters`` steps."""
    node_df = cut_lineage(node_df)
    n = node_df.count()
    v = node_df.select("author", F.lit(1.0 / n).alias("v"))
    if weighted:
        if mem is None:
            raise ValueError("weighted power iteration needs the memberships")
        mem = cut_lineage(mem)
        m = cut_lineage(strength(mem).select("author", F.col("groups").cast("double").alias("m")))
    else:
        sym = cut_lineage(symmetric(edges).select(F.col("src").alias("author"), F.col("dst").alias("to")))
    held = None
    for it in range(iters):
        if weighted:
            g = mem.join(v, "author").groupBy("group_name").agg(F.sum("v").alias("gv"))
            pv = mem.join(g, "group_name").groupBy("author").agg(F.sum("gv").alias("av"))
            av = pv.join(m, "author").join(v, "author").select("author", (F.col("av") - F.col("m") * F.col("v")).alias("av"))
        else:
            av = sym.join(v, "author").groupBy(F.col("to").alias("author")).agg(F.sum("v").alias("av"))
        new = v.join(av, "author", "left").select("author", "v", (F.col("v") + F.coalesce("av", F.lit(0.0))).alias("x"))
        new = new.cache() if (it + 1) % checkpoint_every else cut_lineage(new)
        norm = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        err = new.agg(F.sum(F.abs(F.col("x") / norm - F.col("v")))).first()[0]
        if held is not None:
            held.unpersist()
        held = new
        v = new.select("author", (F.col("x") / norm).alias("v"))
        if not fixed and err < n * tol:
            break
    else:
        if not fixed:
            raise RuntimeError(f"power iteration did not converge in {iters} iterations")
    return v.select("author", F.col("v").alias("eigenvector_centrality"))


# Sources that search at the same time: the state of a search is at most this many times the nodes.
SOURCES_AT_ONCE = 4096


def _source_batches(src: DataFrame, at_once: int):
    """The sources (column s) in consecutive batches, by their index."""
    index = cut_lineage(node_index(src, "s"))
    n = index.agg(F.max("idx")).first()[0]
    for first in range(0, 0 if n is None else n + 1, at_once):
        yield index.filter((F.col("idx") >= first) & (F.col("idx") < first + at_once)).select("s")


def closeness(edges: DataFrame, node_df: DataFrame, mem: DataFrame | None = None, sources: DataFrame | None = None,
              max_hops: int | None = None, at_once: int = SOURCES_AT_ONCE) -> DataFrame:
    """Closeness with the Wasserman-Faust scaling used by networkx,
    (r/(N-1)) * (r / sum of distances), r = reachable others.  Breadth-first
    search from every source (or the given ``sources``) runs as an
    iterative frontier join until no frontier is left (``max_hops`` only if
    the caller wants a cut); with memberships it walks author -> group ->
    author, so no pair table is read.  Exact for all sources.

    Sources search in batches.  The graph is undirected, so a level's neighbours
    lie in it, the one before or the next: only two levels are held, and each is
    reduced to (source, nodes, distance) at once."""
    node_df = cut_lineage(node_df)
    mem = cut_lineage(mem) if mem is not None else None
    n = node_df.count()
    src = (sources if sources is not None else node_df).select(F.col("author").alias("s"))
    if mem is not None:
        hop = lambda fr: (fr.join(mem.withColumnRenamed("author", "a"), "a").select("s", "group_name").distinct()
                          .join(mem, "group_name").select("s", F.col("author").alias("a")))
    else:
        sym = cut_lineage(symmetric(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")))
        hop = lambda fr: fr.join(sym, "a").select("s", F.col("b").alias("a"))
    reached = None
    for batch in _source_batches(src, at_once):
        before, level = None, batch.select("s", F.col("s").alias("a"))
        d = 0
        while max_hops is None or d < max_hops:
            d += 1
            known = level if before is None else level.unionByName(before)
            nxt = cut_lineage(hop(level).distinct().join(known, ["s", "a"], "left_anti"))
            part = cut_lineage(nxt.groupBy("s").agg(F.count(F.lit(1)).alias("r"), (F.count(F.lit(1)) * d).alias("tot")))
            if part.limit(1).count() == 0:
                break
            reached = part if reached is None else reached.unionByName(part)
            before, level = level, nxt
    if reached is None:
        return src.select(F.col("s").alias("author"), F.lit(0.0).alias("closeness_centrality"))
    agg = reached.groupBy("s").agg(F.sum("r").alias("r"), F.sum("tot").alias("tot"))
    return src.join(agg, "s", "left").select(
        F.col("s").alias("author"),
        F.when(F.col("tot") > 0, (F.col("r") / F.lit(max(n - 1, 1))) * (F.col("r") / F.col("tot")))
        .otherwise(F.lit(0.0)).alias("closeness_centrality"))


def betweenness(edges: DataFrame, node_df: DataFrame, sources: DataFrame | None = None,
                max_hops: int | None = None, normalized: bool = True, at_once: int = SOURCES_AT_ONCE) -> DataFrame:
    """Brandes' betweenness on the unweighted graph, all sources (or
    the given ``sources``), in batches.  Forward: breadth-first levels carrying the
    number of shortest paths per (source, node); a new level is told from the
    last two only.  Backward: dependencies flow from each level to the
    previous one through the edges that join consecutive levels, and each batch is
    reduced to a sum per node.  Scaled like networkx (1/((n-1)(n-2)) when
    normalised, 1/2 otherwise for an undirected graph)."""
    node_df = cut_lineage(node_df)
    n = node_df.count()
    sym = cut_lineage(symmetric(edges).select(F.col("src").alias("v"), F.col("dst").alias("w")))
    src = (sources if sources is not None else node_df).select(F.col("author").alias("s"))
    total = None
    for batch in _source_batches(src, at_once):
        part = _dependencies(batch, sym, max_hops)
        if part is not None:
            total = part if total is None else total.unionByName(part)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 0.5
    if total is None:
        return node_df.select("author", F.lit(0.0).alias("betweenness_centrality"))
    b = total.groupBy("v").agg(F.sum("b").alias("b"))
    return (node_df.join(b.withColumnRenamed("v", "author"), "author", "left")
            .select("author", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness_centrality")))


def _dependencies(batch: DataFrame, sym: DataFrame, max_hops: int | None) -> DataFrame | None:
    """(v, b): sum of the dependencies of one batch of sources on each node."""
    level = cut_lineage(batch.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))
    levels = [level]
    while max_hops is None or len(levels) <= max_hops:
        known = level.select("s", "v")
        if len(levels) > 1:
            known = known.unionByName(levels[-2].select("s", "v"))
        nxt = (level.join(sym, "v").select("s", F.col("w").alias("v"), "sigma")
               .join(known, ["s", "v"], "left_anti")
               .groupBy("s", "v").agg(F.sum("sigma").alias("sigma")))
        nxt = cut_lineage(nxt)
        if nxt.limit(1).count() == 0:
            break
        levels.append(nxt)
        level = nxt
    delta = total = None  # dependencies of the deepest level are 0
    for depth in range(len(levels) - 1, 1, -1):
        child = levels[depth].select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"))
        child = child if delta is None else child.join(
            delta.select("s", F.col("v").alias("w"), F.col("delta").alias("dw")), ["s", "w"], "left")
        dw = F.col("dw") if delta is not None else F.lit(0.0)
        contrib = (levels[depth - 1].join(sym, "v").join(child, ["s", "w"])
                   .select("s", "v", (F.col("sigma") / F.col("sw") * (1 + F.coalesce(dw, F.lit(0.0)))).alias("c")))
        delta = cut_lineage(contrib.groupBy("s", "v").agg(F.sum("c").alias("delta")))
        part = delta.groupBy("v").agg(F.sum("delta").alias("b"))
        total = part if total is None else total.unionByName(part)
    return None if total is None else cut_lineage(total.groupBy("v").agg(F.sum("b").alias("b")))
