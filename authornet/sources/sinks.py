"""Sinks (S3-S8): result tables, id-text files, graph exports, matrices and
the per-epoch metric log.  Every writer is a distributed DataFrame write;
nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """S3: Parquet (default) or gzip CSV with a header."""
    w = df.write.mode(mode)
    if fmt == "csv":
        (w.option("header", True).option("compression", "gzip").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
    return path


def write_id_text(df: DataFrame, path: str, key: str = "UID_key", col: str = "final_message_string",
                  mode: str = "overwrite") -> str:
    """``id<TAB>text`` lines, no header, no quoting, null as ''."""
    (df.select(F.col(key).cast("string"), F.coalesce(F.col(col), F.lit("")))
     .write.mode(mode).option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("header", False).csv(path))
    return path


def edge_list(edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``source, target, Weight`` in both directions.  ``edges`` holds
    each unordered pair once as (src, dst, weight).  With an (author, idx)
    index the endpoints become integer node indices."""
    both = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("weight").alias("Weight")) \
        .unionByName(edges.select(F.col("dst").alias("source"), F.col("src").alias("target"),
                                  F.col("weight").alias("Weight")))
    if index is None:
        return both
    a = index.select(F.col("author").alias("source"), F.col("idx").alias("s"))
    b = index.select(F.col("author").alias("target"), F.col("idx").alias("t"))
    return both.join(a, "source").join(b, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "Weight")


def cluster_labels(df: DataFrame, key: str = "author", label: str = "cluster") -> DataFrame:
    """S6."""
    return df.select(key, label)


def save_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """(key, array<double>) embeddings or (src, dst, w) adjacency as Parquet."""
    df.write.mode(mode).parquet(path)
    return path


def log_metrics(spark: SparkSession, rows: list[dict], path: str, params: dict | None = None) -> DataFrame:
    """Append one row per epoch with the run parameters as columns."""
    params = params or {}
    recs = [{**params, **r} for r in rows]
    df = spark.createDataFrame(recs)
    df.write.mode("append").parquet(path)
    return df
