"""Readers for the driver tables and for the reference's own file formats
(S1 message CSV, S2 raw lexicon ``.dic``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into
    the Parquet scan from whatever the caller selects."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MESSAGE_SCHEMA = T.StructType([
    T.StructField("UID_key", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("fwd_message", T.StringType()),
    T.StructField("fwd_author", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("transcribed_message", T.StringType()),
    T.StructField("group_or_channel", T.StringType()),
    T.StructField("group_name", T.StringType()),
])


def read_messages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw message CSV (optionally gzip) with a stray leading index
    column.  Quoted fields may hold commas, quotes and newlines.  Gzip is
    not splittable, so the read is followed by a repartition when asked."""
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE")
           .csv(path))
    keep = [f.name for f in MESSAGE_SCHEMA.fields if f.name in raw.columns]
    df = raw.select(*[F.col(c).cast(MESSAGE_SCHEMA[c].dataType).alias(c) for c in keep])
    df = df.withColumn("date", F.to_date("date")) if "date" in keep else df
    return df.repartition(partitions) if partitions else df


def read_lexicon_dic(spark: SparkSession, path: str) -> DataFrame:
    """Raw Latin-1 ``.dic``: metadata lines, then ``word<TAB>id<TAB>id..``.
    Entry lines are recognised by shape rather than by counting header
    lines.  Returns ``(word string, categories array<int>)``."""
    lines = (spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001")
             .option("quote", "").option("header", False).csv(path).toDF("line"))
    entries = lines.filter(F.col("line").rlike(r"^[^\t]+(\t\d+)+\s*$"))
    parts = F.split(F.trim(F.col("line")), "\t")
    return entries.select(
        F.element_at(parts, 1).alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("int")).alias("categories"))
