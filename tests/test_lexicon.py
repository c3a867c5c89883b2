"""Lexicon matching: exact first, then the longest stem across all categories."""
from authornet.operators import lexicon as L

LEX = [("the", "Article", 9), ("the*", "Other", 6), ("there*", "Cogmech", 20), ("re*", "Affect", 12),
       ("in", "Preps", 10), ("in", "You", 5), ("wir", "We", 3)]


def rates(spark, plan, mode="ratio"):
    lex = spark.createDataFrame(LEX, "word string, cat_name string, categories int")
    df = spark.createDataFrame([
        (1, "The theory there is rest in wir"),
        (2, "THEREFORE thee, re re"),
        (3, ""),
        (4, None),
    ], "UID_key long, final_message_string string")
    out = L.lexicon_rates(df, lex, targets=["Affect", "Other", "We", "You"], plan=plan, mode=mode)
    return {r.UID_key: r for r in out.collect()}


def test_shadowing_and_counts(spark):
    for plan in ("inline", "join"):
        out = rates(spark, plan, mode="count")
        r1 = out[1]
        # the -> exact (Article, not a target); theory -> the* (Other); there -> there* (non-target);
        # rest -> re* (Affect); in -> Preps + You; wir -> We
        assert (r1.liwc_Other, r1.liwc_Affect, r1.liwc_You, r1.liwc_We) == (1, 1, 1, 1), plan
        r2 = out[2]
        # therefore -> there* shadows the*; 'thee,' -> the* (punctuation kept); re, re -> Affect
        assert (r2.liwc_Other, r2.liwc_Affect) == (1, 2), plan
        assert out[3].liwc_Affect == 0 and out[4].liwc_Affect == 0


def test_ratio_divides_by_tokens(spark):
    out = rates(spark, "inline")
    assert abs(out[1].liwc_Affect - 1 / 7) < 1e-12
    assert out[3].liwc_We == 0.0


def test_plans_agree(spark):
    a = rates(spark, "inline")
    b = rates(spark, "join")
    assert {k: tuple(v) for k, v in a.items()} == {k: tuple(v) for k, v in b.items()}


def test_explode_and_name(spark):
    wide = spark.createDataFrame([("ich", [2, 1])], "word string, categories array<int>")
    names = spark.createDataFrame([(1, "Pronoun"), (2, "I")], "categories int, cat_name string")
    out = L.sort_lexicon(L.name_categories(L.explode_lexicon(wide), names)).collect()
    assert [(r.word, r.cat_name, r.categories) for r in out] == [("ich", "I", 2), ("ich", "Pronoun", 1)]


def test_large_lookups_take_the_join_plan(spark):
    """60,000 words are beyond the inline size: same results through a shuffle join."""
    words = [(f"filler{i:06d}padding", "NOUN") for i in range(60_000)] + [("dog", "NOUN"), ("run", "VERB"), ("dog", "NOUN")]
    df = spark.createDataFrame([(1, "Dog dog run"), (2, ""), (3, None), (4, "nothing")], "UID_key long, final_message_string string")
    pos = spark.createDataFrame(words, "word string, pos string")
    assert not L.fits_inline(pos)
    got = {r.UID_key: (r.noun_count, r.verb_count, r.adj_count) for r in L.pos_counts(df, pos).collect()}
    assert got == {1: (2, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    score = spark.createDataFrame([(w, 1) for w, _ in words[:60_000]] + [("dog", -1)], "word string, score int")
    flags = {r.UID_key: (r.positive_sentiment, r.negative_sentiment, r.neutral_sentiment) for r in L.sentiment_flags(df, score).collect()}
    assert flags == {1: (0, 1, 0), 2: (None,) * 3, 3: (None,) * 3, 4: (0, 0, 1)}


def test_join_plan_reads_the_text_once(spark):
    lex = spark.createDataFrame(LEX, "word string, cat_name string, categories int")
    df = spark.createDataFrame([(1, "the theory in wir")], "UID_key long, final_message_string string")
    out = L.lexicon_rates(df, lex, targets=["We"], plan="join", carry=["UID_key"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "final_message_string" not in plan  # everything reads the stored token table


def test_plans_agree_on_repeated_and_null_keys(spark):
    lex = spark.createDataFrame(LEX, "word string, cat_name string, categories int")
    df = spark.createDataFrame([(1, "the theory in wir"), (1, "wir wir"), (None, "wir in"), (None, None), (2, "")],
                               "UID_key long, final_message_string string")
    pos = spark.createDataFrame([("wir", "NOUN"), ("theory", "NOUN"), ("in", "VERB")], "word string, pos string")
    polarity = spark.createDataFrame([("wir", 1), ("theory", -1), ("the", -1)], "word string, score int")
    for run in (lambda plan: L.lexicon_rates(df, lex, targets=["We", "You", "Other"], plan=plan, mode="count"),
                lambda plan: L.lexicon_rates(df, lex, targets=["We", "You", "Other"], plan=plan),
                lambda plan: L.pos_counts(df, pos, plan=plan), lambda plan: L.sentiment_flags(df, polarity, plan=plan)):
        a, b = ([r.asDict() for r in run(plan).collect()] for plan in ("inline", "join"))
        assert sorted(map(repr, a)) == sorted(repr({k: r[k] for k in a[0]}) for r in b)
    counts = L.lexicon_rates(df, lex, targets=["We"], plan="join", mode="count", carry=["UID_key"]).collect()
    assert sorted((r.UID_key or 0, r.liwc_We) for r in counts) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)]
