"""Composite plans: messages -> cleaned messages -> message features ->
author tables.  These are the library's "whole pipeline" entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import textfeat as TF
from ..sources import fixtures as FX
from ..sources.tables import table


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.messages(spark, sf_dir)


def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_messages(raw_messages(spark, sf_dir))


def message_features(spark: SparkSession, sf_dir: str, full: bool = True, lexicon_plan: str = "auto") -> DataFrame:
    clean = clean_messages(spark, sf_dir)
    if not full:
        return TF.message_features(clean)
    return TF.message_features(clean, FX.pos_df(spark), FX.polarity_df(spark), FX.lexicon_df(spark),
                               lexicon_plan=lexicon_plan)


def author_group_table(spark: SparkSession, sf_dir: str, full: bool = False,
                       keys=("author", "group_name")) -> DataFrame:
    """Flagship: P1-P11 -> T1-T7 (+ T8-T11, L* when ``full``) -> A1-A4 +
    J2 + J5 in one aggregation -> A6-A10."""
    feats = message_features(spark, sf_dir, full=full)
    return A.post_features(A.aggregate_features(feats, keys))


def toxicity_scores(spark: SparkSession, sf_dir: str, clean: DataFrame, key: str = "author") -> DataFrame:
    """Per-author score for T12: mean ``labels.toxic`` over the author's own
    messages that carry a label (stands in for the external scorer)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("UID_key"), "toxic")
    own = clean.filter((F.col("own_message") == 1) & F.col(key).isNotNull()).select("UID_key", key)
    return own.join(labels, "UID_key").groupBy(key).agg(F.avg("toxic").alias("toxicity"))


def author_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30-feature author table (plus the Flesch class label).  The
    per-message label join happens on narrow feature rows (the text is
    already reduced to numbers), so the text is scanned and cleaned once."""
    clean = clean_messages(spark, sf_dir)
    feats = TF.message_features(clean, FX.pos_df(spark), FX.polarity_df(spark), FX.lexicon_df(spark))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("UID_key"), F.col("toxic").cast("double").alias("_tox"))
    feats = feats.drop("final_message", "final_message_string", "fwd_message", "fwd_message_string") \
        .join(labels, "UID_key", "left")  # AQE broadcasts a small label table
    agg = A.post_features(A.aggregate_features(feats, ["author"], extra_means=["_tox"]))
    agg = agg.withColumn("toxicity", F.when(F.col("own_message") == 1, F.col("_tox"))).drop("_tox")
    return agg.select("author", *A.FEATURES_30, "avg_flesch_reading_ease_class")


NARROW = ["UID_key", "author", "group_name", "group_or_channel", "date", "own_message", "forwarded_message",
          "fwd_author"]


def narrow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned messages without their text (keys and flags only), written
    once to the checkpoint folder: graph and count plans that need the
    message table several times read this instead of re-cleaning text."""
    from ..session import cut_lineage
    return cut_lineage(clean_messages(spark, sf_dir).select(*NARROW))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (the oracle twin rounds the same way)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


SCORED_SHAPE = (128, 9)  # exported shape: 30 features -> hidden -> embedding
SCORED_CLUSTERS = 6


def scored_weights(hidden: int = SCORED_SHAPE[0], embedding: int = SCORED_SHAPE[1], k: int = SCORED_CLUSTERS) -> dict:
    """Rule-made weights of the three layers and the centres."""
    from ..operators import propagate as N
    return N.rule_layers([len(A.FEATURES_30), hidden, embedding, embedding], clusters=k)


def scored_authors(spark: SparkSession, sf_dir: str, weights: dict | None = None, t: int = 2) -> DataFrame:
    """The reference's final table: the 30 author features, the hard
    cluster and one probability per cluster from the attention encoder
    (``weights``: trained elsewhere; :func:`scored_weights` when not given), plus degree
    and degree centrality of the author graph."""
    from ..operators import graph as G
    from ..operators import propagate as N
    from ..session import cut_lineage
    w = weights or scored_weights()
    feats = cut_lineage(author_table(spark, sf_dir))                 # N authors x 31 columns
    x = C.assemble(C.fill_zero(feats, A.FEATURES_30), A.FEATURES_30, keep=["author"])
    mem = G.memberships(narrow_messages(spark, sf_dir))
    edges = cut_lineage(G.pair_weights(G.author_pairs(mem)))
    q = N.score_authors(x, G.transition(edges, mem, t=t), w, w["centres"])
    deg = G.degree_centrality(G.degree(edges, mem.select("author").distinct()))
    return feats.join(N.cluster_table(q, len(w["centres"])), "author", "left").join(deg, "author", "left")
