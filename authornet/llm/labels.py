"""Labelled training rows: a bounded sample, the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a model is fitted on, at most; the smallest hashes of all labelled ids.
MAX_TRAINING_ROWS = 40_000
FOLDS, HELD_OUT_FOLD = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT_FOLD


def training_rows(spark: SparkSession, sf_dir: str, label: str, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows outside the held-out fold, as a
    local table that may be broadcast (16 bytes a row).  Repeated ids count once (largest label);
    null ids and labels are left out."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("y"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = [(r["doc_id"], r["y"]) for r in one.collect()]
    return spark.createDataFrame(rows, "doc_id bigint, y int")
