"""Author aggregation (A1-A10, J2-J5, T12) on literal rows."""
from pyspark.sql import functions as F

from authornet.operators import aggregate as A
from authornet.operators import textfeat as TF
from authornet.operators import clean as C

SCHEMA = ("UID_key long, author string, message string, fwd_message string, fwd_author string, "
          "date string, transcribed_message string, group_or_channel string, group_name string")


def features(spark, rows):
    return TF.message_features(C.clean_messages(spark.createDataFrame(rows, SCHEMA)))


ROWS = [
    (1, "a", "Hi there.", None, None, "2021-01-01", None, "group", "g1"),
    (2, "a", "Hello!", None, None, "2021-01-01", None, "group", "g1"),
    (3, "b", None, "fwd", "a", "2021-01-01", None, "group", "g1"),       # b forwards a
    (4, "b", None, "fwd", "A", "2021-01-01", None, "group", "g1"),       # raw 'A' never matches
    (5, "c", "x", None, None, "2021-01-01", None, "channel", "g2"),
    (6, None, "y", "z", "a", "2021-01-01", None, "channel", "g1"),       # null author still counts for a
]


def test_fused_equals_separate_merges(spark):
    f = features(spark, ROWS)
    fused = A.aggregate_features(f, ["author", "group_name"])
    sep = A.was_forwarded(A.merge_counts(A.linguistic(f), A.message_counts(f)), f)
    cols = ["author", "group_name", "sent_count", "word_count", "own_message", "forwarded_message",
            "total_message_count", "was_forwarded", "channel_messages", "group_messages"]
    a = sorted(tuple(r) for r in fused.select(*cols).collect())
    b = sorted(tuple(r) for r in sep.select(*cols).collect())
    assert a == b


def test_forward_only_author_has_null_features_and_counts(spark):
    out = {(r.author, r.group_name): r for r in A.aggregate_features(features(spark, ROWS)).collect()}
    b = out[("b", "g1")]
    assert b.sent_count is None and b.group_messages is None
    assert (b.own_message, b.forwarded_message, b.total_message_count) == (0, 2, 2)
    a = out[("a", "g1")]
    assert a.was_forwarded == 2 and a.sent_count == 2.0 and a.word_count == 1.5 and a.group_messages == 2
    assert (None, "g1") not in out


def test_features_that_no_one_reads_are_not_computed(spark):
    f = features(spark, ROWS).withColumn("noun_count", F.expr("raise_error('computed')").cast("bigint"))
    out = A.aggregate_features(f, ["author"]).select("author", "word_count", "was_forwarded", "total_message_count")
    assert {r.author: tuple(r)[1:] for r in out.collect()}["a"][1:] == (2, 2)
    assert "computed" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_keys_among_the_carried_columns(spark):
    out = A.aggregate_features(features(spark, ROWS), ["author", "group_or_channel"]).collect()
    assert {(r.author, r.group_or_channel): r.total_message_count for r in out}[("c", "channel")] == 1


def test_post_features_and_toxicity_gate(spark):
    agg = A.post_features(A.aggregate_features(features(spark, ROWS), ["author"]))
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.1)], "author string, toxicity double")
    out = {r.author: r for r in TF.toxicity(agg, scores).collect()}
    assert out["a"].own_message == 1.0 and out["a"].toxicity == 0.5
    assert out["b"].own_message == 0.0 and out["b"].toxicity is None
    assert out["b"].group_messages is None  # share of own messages undefined


def test_join_texts_in_key_order_skipping_empty(spark):
    df = spark.createDataFrame([(3, "a", "three"), (1, "a", "one"), (2, "a", ""), (4, "a", None)],
                               "UID_key long, author string, final_message_string string")
    out = A.join_texts(df, ["author"]).collect()
    assert [(r.author, r.part, r.final_message_string) for r in out] == [("a", 0, "one three")]


def test_join_texts_with_string_order_is_whole(spark):
    rows = [("a", f"k{i:03d}", f"t{i}") for i in range(10)] + [("b", "k000", "x")]
    df = spark.createDataFrame(rows, "author string, ts string, final_message_string string").repartition(3)
    out = A.join_texts(df, ["author"], order="ts", part_rows=4).collect()
    parts = {}
    for r in out:
        parts.setdefault(r.author, []).append((r.part, r.final_message_string))
    joined = {a: " ".join(t for _, t in sorted(v)) for a, v in parts.items()}
    assert joined == {"a": " ".join(f"t{i}" for i in range(10)), "b": "x"}
    assert sorted(p for p, _ in parts["a"]) == [0, 1, 2] and parts["b"] == [(0, "x")]  # numbered within the author
