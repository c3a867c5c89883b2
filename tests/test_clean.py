"""Cleaning rules (P1-P14) on literal message rows."""
from pyspark.sql import functions as F

from authornet.operators import clean as C

SCHEMA = ("UID_key long, author string, message string, fwd_message string, fwd_author string, "
          "date string, transcribed_message string, group_or_channel string, group_name string")


def msgs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_transcription_never_cleaned_and_emoji_only_stays_empty(spark):
    rows = [
        (1, "A", None, None, None, "2021-01-01", "trans <b>x</b> \U0001F600", "group", "g"),
        (2, "A", "\U0001F600\U0001F600", None, None, "2021-01-01", "spoken", "group", "g"),
        (3, "A", "\U0001F600", "fwd text", "b", "2021-01-01", None, "group", "g"),
    ]
    out = {r.UID_key: r for r in C.clean_messages(msgs(spark, rows)).collect()}
    assert out[1].final_message_string == "trans <b>x</b> \U0001F600"
    # row 2: own text empties, no forward -> dropped (both '' ... fwd is null -> kept!)
    assert 2 in out and out[2].final_message_string == ""
    assert out[3].final_message_string == "" and out[3].fwd_message_string == "fwd text"


def test_drop_only_when_both_texts_empty(spark):
    rows = [
        (1, "a", "\U0001F600", "\U0001F389", "b", "2021-01-01", None, "group", "g"),   # both '' -> drop
        (2, "a", "\U0001F600", None, None, "2021-01-01", None, "group", "g"),          # fwd null -> keep
        (3, "a", None, None, None, "2021-01-01", None, "group", "g"),                   # no text -> P6 drop
    ]
    keys = sorted(r.UID_key for r in C.clean_messages(msgs(spark, rows)).collect())
    assert keys == [2]


def test_flags_and_author(spark):
    rows = [(1, "  Bob ", "hi", "fw", "x", "2021-01-02", None, "channel", "g"),
            (2, None, None, None, None, "2021-01-02", "t", "group", "g")]
    out = {r.UID_key: r for r in C.clean_messages(msgs(spark, rows)).collect()}
    assert out[1].author == "bob" and out[1].own_message == 1 and out[1].forwarded_message == 1
    assert out[2].author is None and out[2].own_message == 1 and out[2].forwarded_message == 0
    assert str(out[1].date) == "2021-01-02"


def test_sample_n_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "UID_key")
    a = [r[0] for r in C.sample_n(df, 37, seed=5).collect()]
    b = [r[0] for r in C.sample_n(df, 37, seed=5).collect()]
    c = [r[0] for r in C.sample_n(df, 37, seed=6).collect()]
    assert len(a) == 37 and a == b and a != c


def test_balanced_sample_refills_shortfall(spark):
    df = spark.createDataFrame([(i, "channel" if i < 10 else "group") for i in range(100)],
                               "UID_key long, group_or_channel string")
    got = C.sample_balanced(df, 40).groupBy("group_or_channel").count().collect()
    assert {r[0]: r[1] for r in got} == {"channel": 10, "group": 30}


def test_batch_ids_consecutive(spark):
    df = spark.range(0, 250, 1, 7).withColumnRenamed("id", "UID_key")
    got = {r.UID_key: r.batch_id for r in C.batch_ids(df, 100).collect()}
    assert got[0] == 0 and got[99] == 0 and got[100] == 1 and got[249] == 2


def test_union_tagged_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "UID_key long, message string")
    b = spark.createDataFrame([(2, "y", "t")], "UID_key long, message string, transcribed_message string")
    out = C.union_tagged({"group": a, "channel": b}).orderBy("UID_key").collect()
    assert out[0].group_or_channel == "group" and out[0].transcribed_message is None
    assert out[1].group_or_channel == "channel"


def test_sample_picks_rows_by_key_alone(spark):
    df = spark.range(0, 500, 1, 5).select(F.col("id").alias("UID_key"), F.lit("a long text").alias("text"))
    picked = C.sample_n(df, 37, seed=5)
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert picked.columns == ["UID_key", "text"] and picked.count() == 37 and "LeftSemi" in plan
    assert C.sample_n(df, 10_000, seed=5).count() == 500


def test_balanced_sample_over_many_strata(spark):
    sizes = {"a": 1, "b": 2, "c": 30, "d": 50, "e": 50}
    rows = [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "UID_key string, g string")
    for n in (0, 4, 5, 23, 101, 133, 500):
        left, quota = n, {}
        order = sorted(sizes, key=lambda g: (sizes[g], g))
        for i, g in enumerate(order):
            quota[g] = min(left // (len(order) - i), sizes[g])
            left -= quota[g]
        got = {r[0]: r[1] for r in C.sample_balanced(df, n, "g").groupBy("g").count().collect()}
        assert got == {g: q for g, q in quota.items() if q}


def test_every_document_keeps_its_whole_text(spark):
    from authornet.sources import fixtures as FX
    from authornet.sources.tables import table
    sf = "/root/testdata/sf0.001"
    m = FX.messages(spark, sf)
    held = m.select(F.col("UID_key").alias("doc_id"), F.coalesce("fwd_message", "transcribed_message", "message").alias("held"))
    docs = table(spark, sf, "documents").join(held, "doc_id", "left")
    assert docs.filter(~F.coalesce(F.startswith("held", "text"), F.lit(False))).count() == 0
    extra = {r.UID_key // 1_000_000_000 for r in m.select("UID_key").collect()}
    assert extra == {0, 1, 2, 3}  # emoji-only, emptied and blank messages are rows of their own


def test_preprocess_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "The houses are BIG"), (2, None), (3, "")], "UID_key long, t string")
    lem = spark.createDataFrame([("houses", "house")], "word string, lemma string")
    out = C.preprocess_text(df, "t", ["the"], lem)
    assert [r.preprocessed for r in out.orderBy("UID_key").collect()] == ["house are big", "", ""]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_preprocess_joins_a_large_lemma_table(spark):
    """60,000 lemmas are beyond the inline size: same result, keys repeated and null."""
    from authornet.operators import lexicon as L
    df = spark.createDataFrame([(1, "The houses are BIG, the Houses"), (1, "mice and houses"), (None, "Mice"), (None, None), (3, ""),
                                (4, "the")], "UID_key long, t string")
    few = [("houses", "house"), ("mice", "mouse"), ("mice", "mousse"), ("big", None), (None, "x")]
    many = few + [(f"filler{i:06d}padding", "filler") for i in range(60_000)]
    small, large = (spark.createDataFrame(rows, "word string, lemma string") for rows in (few, many))
    assert L.fits_inline(small) and not L.fits_inline(large)
    got = [C.preprocess_text(df, "t", ["the"], lem) for lem in (small, large)]
    assert got[0].columns == got[1].columns == ["UID_key", "t", "preprocessed"]
    a, b = (sorted(map(str, x.collect())) for x in got)
    assert a == b
    assert sorted(r.preprocessed for r in got[1].collect()) == ["", "", "", "house are big house", "mouse", "mouse and house"]
