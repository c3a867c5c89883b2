"""The whole analysis as one call: every stage's table is written once and the next
stage reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import graph as G
from ..operators import propagate as N
from ..operators import textfeat as TF
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources.sinks import write_table
from ..sources.tables import table
from .authors import NARROW, scored_weights


def full_feature_analysis(spark: SparkSession, messages: DataFrame, out_dir: str, pos: DataFrame, polarity: DataFrame,
                          lexicon: DataFrame, scores: DataFrame, weights: dict | None = None) -> dict[str, DataFrame]:
    """Raw messages -> cleaned messages -> message features -> author x group and author
    tables (with the toxicity of ``scores``: UID_key, toxic) -> author graph -> clusters.
    Writes ``out_dir/<stage>`` and returns the tables read back."""
    tables: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out_dir}/{name}")
        tables[name] = spark.read.schema(df.schema).parquet(f"{out_dir}/{name}")
        return tables[name]

    clean = stage("messages", C.clean_messages(messages))
    texts = ["final_message", "final_message_string", "fwd_message", "fwd_message_string"]
    feats = stage("message_features", TF.message_features(clean, pos, polarity, lexicon).drop(*texts))
    stage("author_group", A.post_features(A.aggregate_features(feats, ["author", "group_name"])))
    marked = feats.join(scores.select("UID_key", F.col("toxic").cast("double").alias("_tox")), "UID_key", "left")
    agg = A.post_features(A.aggregate_features(marked, ["author"], extra_means=["_tox"]))
    agg = agg.withColumn("toxicity", F.when(F.col("own_message") == 1, F.col("_tox")))
    authors = stage("authors", agg.select("author", *A.FEATURES_30, "avg_flesch_reading_ease_class"))
    members = stage("memberships", G.memberships(clean.select(*NARROW)))
    edges = stage("edges", G.pair_weights(G.author_pairs(members)))
    w = weights or scored_weights()
    x = C.assemble(C.fill_zero(authors, A.FEATURES_30), A.FEATURES_30, keep=["author"])
    q = N.score_authors(x, G.transition(edges, members, t=2), w, w["centres"])
    nodes = members.select("author").distinct()
    degree = G.degree_centrality(G.degree(edges, nodes), nodes)
    stage("scored", authors.join(N.cluster_table(q, len(w["centres"])), "author", "left").join(degree, "author", "left"))
    return tables


def analysis_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The analysis of the driver's tables as they are now."""
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("UID_key"), "toxic")
    return full_feature_analysis(spark, FX.messages(spark, sf_dir), scratch_path(spark, "analysis"), FX.pos_df(spark),
                                 FX.polarity_df(spark), FX.lexicon_df(spark), scores)
