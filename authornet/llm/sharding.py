"""Shards of equal bytes, tokens and rows by vector bin packing.

The unit is a group of equal texts.  Its load is the vector (bytes, tokens, rows), as shares of the
whole.  Groups with a noticeable share in any dimension are items of their own (there can be only a
few); a group beyond a quarter of a shard is split into chunks of a sixteenth.  All other groups are
gathered into a fixed number of cells by their hash, and a cell is an item.  So the number of items depends
on the number of shards alone, and the packing is done on that bounded list: largest first, each
where the dot product of its load with the shard's residual capacity is highest, shards with room
for it before the others.

Slots number the rows of a shard without gaps: rank inside (block, shard), plus the rows of that
shard in earlier blocks (a two-level prefix sum); blocks are the tasks that read the texts.

Edge cases: null and empty texts weigh 16 bytes, no token, one row, and are one group; an empty
table gives an empty result; repeated rows each get a slot; a single text larger than a shard
cannot be cut and leaves its shard the largest; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
OVERHEAD_BYTES = 16
CELLS_PER_SHARD = 256
# shares of one shard from which a group is an item of its own, is split, and the size of its chunks
OWN_ITEM, SPLIT, CHUNK = 1 / 64, 1 / 4, 1 / 16
LOADS = ("bytes", "tokens", "rows")
KEY = ("h", "crc", "size")


def pack_items(loads: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item; ``loads``: (items, 3), shares of the whole."""
    residual = np.full((n_shards, loads.shape[1]), 1 / n_shards)
    out = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1))):
        fit = residual @ loads[i]
        roomy = (residual >= loads[i]).all(axis=1)
        if roomy.any():
            fit = np.where(roomy, fit, -np.inf)
        out[i] = int(fit.argmax())
        residual[out[i]] -= loads[i]
    return out


def shard(df: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = df.sparkSession
    text = F.col("text")
    words = F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), ""))
    raw = common.texts(df).select(
        "doc_id", (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), words.cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"),
        F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = common.write_shared(raw, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = np.array([max(1, x or 0) for x in rows.agg(*sums).first()], dtype=float)
    share = F.greatest(*[F.col(c) / float(t) for c, t in zip(LOADS, total)])
    groups = rows.groupBy(*KEY).agg(*sums).withColumn("share", share * n_shards)
    # at most 3 * n_shards / OWN_ITEM groups can hold such a share
    large = groups.filter(F.col("share") >= OWN_ITEM).withColumn(
        "chunks", F.when(F.col("share") > SPLIT, F.ceil(F.col("share") / CHUNK)).otherwise(F.lit(1)).cast("int")
    ).select(*KEY, "chunks")
    known = [tuple(r) for r in large.collect()]
    schema = "h bigint, crc bigint, size bigint, chunks int"
    tagged = rows.join(F.broadcast(spark.createDataFrame(known, schema)), list(KEY), "left").withColumn(
        "item", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("h", "size", "crc"), F.lit(n_shards * CELLS_PER_SHARD)))
        .otherwise(F.xxhash64("h", "size", "crc", F.pmod(F.xxhash64("row"), F.col("chunks")))))
    tagged = tagged.withColumn("own", F.col("chunks").isNotNull())
    # bounded by cells + chunks of large groups, whatever the table
    items = tagged.groupBy("own", "item").agg(*sums).orderBy("own", "item").collect()
    loads = np.array([[r[c] for c in LOADS] for r in items], dtype=float).reshape(-1, len(LOADS)) / total
    shards = pack_items(loads, n_shards)
    plan = spark.createDataFrame([(r["own"], r["item"], int(s)) for r, s in zip(items, shards)],
                                 "own boolean, item bigint, shard int")
    placed = tagged.join(F.broadcast(plan), ["own", "item"])
    counts = placed.groupBy("block", "shard").agg(F.count("*").alias("n"))
    starts = common.exclusive_prefix(counts, "block", "n", "before", by=("shard",)).select("block", "shard", "before")
    rank = F.row_number().over(Window.partitionBy("block", "shard").orderBy("row"))
    return placed.withColumn("rank", rank).join(starts, ["block", "shard"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes."""
    out = shard(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
