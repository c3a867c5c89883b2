"""Structured Streaming form of the per-message stage.

The reference has no streaming.  Cleaning (P1-P11) and the message features
(T1-T11, lexicon rates with the inline plan) are row-wise and stateless, so
the same plan runs unchanged on a streaming DataFrame: new message files
are cleaned and scored as they arrive and appended to a Parquet sink.  The
aggregation to authors stays a batch job over the sink (its groups span
the whole history; no watermark could close them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as C
from ..operators import textfeat as TF

RAW_SCHEMA = ("UID_key long, author string, message string, fwd_message string, fwd_author string, "
              "transcribed_message string, group_name string, group_or_channel string, date date")


def message_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def stream_message_features(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                            pos_lexicon: DataFrame | None = None, polarity: DataFrame | None = None,
                            lexicon: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream: raw message files -> cleaned, scored rows appended
    to ``sink_dir``.  ``checkpoint_dir`` must be on shared storage so the
    query resumes after a failure without loss or duplicates."""
    feats = TF.message_features(C.clean_messages(message_stream(spark, source_dir)), pos_lexicon, polarity, lexicon)
    writer = (feats.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
