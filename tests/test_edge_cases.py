"""Degenerate inputs: empty tables, graphs without edges, lexicons without
stems, constant columns, classes never predicted."""
import numpy as np
from pyspark.sql import functions as F

from authornet.operators import aggregate as A
from authornet.operators import clean as C
from authornet.operators import graph as G
from authornet.operators import lexicon as L
from authornet.operators import stats as ST
from authornet.operators import textfeat as TF

SCHEMA = ("UID_key long, author string, message string, fwd_message string, fwd_author string, "
          "date string, transcribed_message string, group_or_channel string, group_name string")


def test_empty_messages(spark):
    raw = spark.createDataFrame([], SCHEMA)
    feats = TF.message_features(C.clean_messages(raw))
    assert A.post_features(A.aggregate_features(feats)).count() == 0


def test_graph_without_edges(spark):
    mem = spark.createDataFrame([("g1", "a"), ("g2", "b"), ("g3", "c")], "group_name string, author string")
    edges = G.pair_weights(G.author_pairs(mem))
    nodes = mem.select("author").distinct()
    assert edges.count() == 0
    assert {r.degree for r in G.degree(edges, nodes).collect()} == {0}
    m = {(r.src, r.dst): r.m for r in G.transition(edges, mem).collect()}
    assert m == {("a", "a"): 1.0, ("b", "b"): 1.0, ("c", "c"): 1.0}
    assert {r.closeness_centrality for r in G.closeness(edges, nodes, mem=mem).collect()} == {0.0}
    assert {r.betweenness_centrality for r in G.betweenness(edges, nodes).collect()} == {0.0}


def test_lexicon_without_stems(spark):
    lex = spark.createDataFrame([("wir", "We", 3)], "word string, cat_name string, categories int")
    df = spark.createDataFrame([(1, "wir wir ihr")], "UID_key long, final_message_string string")
    for plan in ("inline", "join"):
        r = L.lexicon_rates(df, lex, targets=["We"], plan=plan, mode="count").first()
        assert r.liwc_We == 2, plan


def test_constant_column_histogram_and_ranks(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "k int, v double")
    h = ST.histogram(df, "v", bins=3).collect()
    assert sum(r["count"] for r in h) == 5
    ranks = {r.rank for r in ST.average_rank(df, ["v"], "k").collect()}
    assert ranks == {3.0}


def test_report_with_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "label int, prediction int")
    rep = {r.cls: r for r in ST.class_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert abs(rep["0"].precision - 1 / 3) < 1e-12
