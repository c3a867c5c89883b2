"""The per-message stage gives the same rows as a stream and as a batch."""
from authornet.plans.authors import raw_messages
from authornet.operators import clean as C
from authornet.operators import textfeat as TF
from authornet.sources import fixtures as FX
from authornet.streaming.features import stream_message_features


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    raw = raw_messages(spark, sf)
    raw.repartition(3).write.parquet(src)
    q = stream_message_features(spark, src, sink, ck, FX.pos_df(spark), FX.polarity_df(spark), FX.lexicon_df(spark))
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    batch = TF.message_features(C.clean_messages(raw), FX.pos_df(spark), FX.polarity_df(spark), FX.lexicon_df(spark))
    cols = ["UID_key", "word_count", "sent_count", "noun_count", "positive_sentiment", "liwc_Affect", "flesch_reading_ease"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
