"""Helpers shared by the operators of this subpackage: table access, written
intermediates in the shared folder, stable row numbers and prefix sums."""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from authornet.session import ensure_checkpoint_dir

# How many neighbouring blocks one task sums in a two-level prefix sum.
PREFIX_FANOUT = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones; every other column is
    left behind here, so extra columns can never clash with an operator's own."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def write_shared(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder (with ``options`` of the Parquet writer) and read it back.
    The files cut the lineage and outlive any executor; they are deleted when
    the session's process ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have gone already; nothing depends on this
        pass


def exclusive_prefix(df: DataFrame, order: str, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller ``order``
    (a gapless-enough non-negative long, unique within ``by``).  Two levels: sums
    inside blocks of ``PREFIX_FANOUT`` orders, then sums over the block totals, so no
    task sees more than the blocks of one key."""
    block = F.floor(F.col(order) / F.lit(PREFIX_FANOUT)).alias("_block")
    cut = df.withColumn("_block", block)
    totals = cut.groupBy(*by, "_block").agg(F.sum(value).alias("_total"))
    before = Window.unboundedPreceding
    w_top = Window.partitionBy(*by).orderBy("_block").rowsBetween(before, -1)
    w_in = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(before, -1)
    starts = totals.select(*by, "_block", F.coalesce(F.sum("_total").over(w_top), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_inside", F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    return (inside.join(starts, [*by, "_block"]).withColumn(out, F.col("_start") + F.col("_inside"))
            .drop("_block", "_start", "_inside"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def send(spark: SparkSession, model) -> Callable[[], object]:
    """Broadcast a bounded model together with its classes, so that executors need not
    have this package installed; call the result inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)
