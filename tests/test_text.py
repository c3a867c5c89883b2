"""Per-message expressions: the reference's quirks on hand-written literals."""
from pyspark.sql import functions as F

from authornet.functions import patterns as P
from authornet.functions import text as X


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expr("t").alias("r")).first()["r"]


def test_sentence_pieces_count_trailing_piece(spark):
    assert one(spark, "Hi.", X.sent_count) == 2
    assert one(spark, "Hi", X.sent_count) == 1
    assert one(spark, "Wow!!! Really?? Yes.", X.sent_count) == 4
    assert one(spark, "", X.sent_count) == 0
    assert one(spark, None, X.sent_count) == 0


def test_word_count_is_unicode(spark):
    assert one(spark, "Äpfel und Birnen, bitte!", X.word_count) == 4
    assert one(spark, "snake_case 42x", X.word_count) == 2


def test_runs_and_averages(spark):
    assert one(spark, "Nein!!! Ja! Was??", X.exclamation_count) == 2
    assert one(spark, "Nein!!! Ja! Was??", X.question_count) == 1
    assert one(spark, "ab cd.", X.avg_word_length) == 2.5  # '.' counts as a character
    assert one(spark, "", X.avg_sent_length) == 0.0


def test_emoji_runs_and_removal(spark):
    s = "Hi \U0001F600\U0001F389 there \U0001F389"
    assert one(spark, s, X.emoji_count) == 2
    assert one(spark, s, X.remove_emojis) == "Hi  there "


def test_remove_tags_drops_link_text_keeps_other_text(spark):
    s = '<b>Nein</b>!!! <a href="http://x.example/1">link</a> ich'
    assert one(spark, s, X.remove_tags) == "Nein!!!  ich"


def test_collapse_ws_and_strip_lower(spark):
    assert one(spark, "a \t\n b c", X.collapse_ws) == "a b c"
    assert one(spark, "  Author_7 ", X.strip_lower) == "author_7"
    assert one(spark, None, X.strip_lower) is None


def test_flesch_bands(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (29.99,), (30.0,), (100.5,), (101.0,), (None,)], "s double")
    got = [r[0] for r in df.select(X.flesch_class("s")).collect()]
    assert got == ["unclassified", "very confusing", "very confusing", "difficult", "very easy",
                   "unclassified", "unclassified"]


def test_flesch_null_for_blank(spark):
    assert one(spark, " ", X.flesch_de) is None
    assert one(spark, "!!!", X.flesch_de) is None
    v = one(spark, "Das ist gut.", X.flesch_de)
    # 3 words, 1 sentence, 4 vowel groups (Das, ist, gut -> a, i, u) = 3 syllables
    assert abs(v - (180 - 3 / 1 - 58.5 * 3 / 3)) < 1e-9


def test_batch_scorer_sees_every_piece(spark):
    import pandas as pd
    from authornet.operators import textfeat as TF
    df = spark.createDataFrame([(1, "a" * 25), (2, "!!"), (3, ""), (4, None)], "UID_key long, t string")
    seen = lambda s: s.str.len().astype("float64")  # noqa: E731  a piece scores its length
    got = {r.UID_key: r.score for r in TF.score_batches(df, "t", seen, max_chars=10).collect()}
    assert got == {1: (10 * 10 + 10 * 10 + 5 * 5) / 25, 2: 2.0, 3: 0.0, 4: None}


def test_batch_scorer_retries_and_gives_up(spark):
    from authornet.operators import textfeat as TF
    df = spark.createDataFrame([(1, "x")], "UID_key long, t string")

    def broken(s):
        raise OSError("no answer")
    out = TF.score_batches(df, "t", broken, retries=2, backoff=1.0, sleep=lambda _: None).collect()
    assert out[0].score is None


def test_failed_scores_are_told_from_results(spark):
    import pandas as pd
    import pytest
    from authornet.operators import textfeat as TF
    df = spark.createDataFrame([(1, "x" * 30), (2, "y" * 30), (3, None), (4, "")], "k int, t string").coalesce(1)

    def broken(s):
        raise OSError("no answer")

    def partly(s):  # no score for a text's last ten characters
        return pd.Series([None if t is None or t == "y" * 9 + "!" else float(len(t)) for t in s], dtype="float64")
    quiet = {"retries": 2, "sleep": lambda _: None}
    for most in (None, 10):
        got = {r.k: (r.score, r.score_error) for r in TF.score_batches(df, "t", broken, max_chars=most, **quiet).collect()}
        assert {v for v, _ in got.values()} == {None} and all("no answer" in e for _, e in got.values())
        with pytest.raises(Exception, match="no answer"):
            TF.score_batches(df, "t", broken, max_chars=most, on_failure="raise", **quiet).collect()
    scored = {r.k: (r.score, r.score_error) for r in TF.score_batches(df, "t", partly, max_chars=10, on_failure="raise", **quiet).collect()}
    assert scored == {1: (10.0, None), 2: (10.0, None), 3: (None, None), 4: (0.0, None)}
    cut = df.unionAll(spark.createDataFrame([(5, "y" * 29 + "!")], "k int, t string")).coalesce(1)
    marked = {r.k: (r.score, r.score_error) for r in TF.score_batches(cut, "t", partly, max_chars=10, **quiet).collect()}
    assert marked == scored | {5: (None, "the scorer gave no score")}  # two thirds of its score before


def test_text_toxicity_fails_with_its_scorer(spark, monkeypatch):
    import pytest
    import __spark_entry__ as E
    from authornet.plans import q_authors

    def broken(s):
        raise OSError("no answer")
    monkeypatch.setattr(q_authors, "_shout_scorer", broken)
    with pytest.raises(Exception, match="no answer"):
        E.queries()["t12_text_toxicity"](spark, "/root/testdata/sf0.001").collect()


def test_chunks_hold_the_whole_text(spark):
    from authornet.functions import text as X
    df = spark.createDataFrame([("abcdefg",), ("",), (None,), ("abc",)], "t string")
    assert [r[0] for r in df.select(X.chunk_text("t", 3)).collect()] == [["abc", "def", "g"], [""], None, ["abc"]]


def test_fast_paths_give_what_the_patterns_give(spark):
    texts = [None, "", " ", "  ", "a b", "a  b", "\ta\n\r b ", "x\u00a0\u2003 y\u3000", "caf\u00e9  \u0085z", "<b>Nein</b> 3 < 4", "plain!!! what?? \U0001F600\U0001F600 ja",
             "\u200d", "!?!", '<a href="x">gone</a>\x1c\x1f.', "\u00c4rger\x0b\x0cund"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    whole = lambda pattern, to: F.regexp_replace("t", P.java(pattern), to)
    count = lambda pattern: F.coalesce(F.regexp_count("t", F.lit(P.java(pattern))).cast("bigint"), F.lit(0).cast("bigint"))
    pairs = [(X.remove_tags("t"), F.regexp_replace(whole(P.A_TAG, ""), P.java(P.PLAIN_TAG), "")), (X.exclamation_count("t"), count(P.EXCLAMATION)),
             (X.question_count("t"), count(P.QUESTION)), (X.emoji_count("t"), count(P.EMOJI_CLASS + "+"))]
    for row in df.select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect():
        assert all(v.a == v.b for v in row)
    plan = df.select(X.exclamation_count("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()  # no pattern runs over a text without the character


def test_target_masks_find_the_entries_that_catch_a_token(spark):
    from authornet.operators import lexicon as L
    from authornet.sources import fixtures as FX
    lex, targets = L.InlineLexicon(FX.lexicon_df(spark)), P.LEXICON_TARGETS
    words = ["the", "that", "thats", "th", "there", "therefore", "then", "re", "red", "in", "inn", "i", "on", "one", "ones", "e", "er", "\u00e9r"]
    toks = F.array(*[F.lit(w) for w in words])
    row = spark.range(1).select(F.transform(toks, lambda t: F.struct(*[lex.category_hits(lex.entry_keys(F.array(t)), c).alias(c) for c in targets])).alias("old"),
                                F.transform(toks, lambda t: F.struct(*[F.size(F.filter(lex.target_masks(F.array(t), targets), lambda m: m.bitwiseAND(F.lit(1 << i)) != 0))
                                                                       .cast("bigint").alias(c) for i, c in enumerate(targets)])).alias("new")).first()
    assert row.old == row.new and sum(map(sum, row.old)) > 8


def test_long_texts_are_cut_a_few_at_a_time(spark, monkeypatch, tmp_path):
    from authornet.operators import textfeat as TF
    seen = tmp_path / "seen"

    def score(s):
        with seen.open("a") as f:
            f.write(f"{s.str.len().sum()}\n")
        return s.str.count("a") / s.str.len().clip(lower=1)

    df = spark.createDataFrame([(i, "ab" * 500 if i % 3 else None) for i in range(30)], "k int, t string").coalesce(1)
    monkeypatch.setattr(TF, "CHARS_AT_ONCE", 4000)
    got = {r.k: r.score for r in TF.score_batches(df, "t", score, max_chars=100).collect()}
    assert len(got) == 30 and {v for k, v in got.items() if k % 3} == {0.5}
    assert max(map(float, seen.read_text().split())) <= 5000  # all 20,000 at once before


def test_cheaper_patterns_give_the_same_runs(spark):
    """Against the plain patterns in Python, on characters at the edges of the classes."""
    import random
    import re
    plain = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].zfill(8), p)
    rng = random.Random(4)
    letters = " \t\n\x0b\x1b\x1c\x1f !a\x84\x85\xa0ä\u1680\u2000\u200a\u200b\u200c\u200d\u200e\u2028\u205f\u231a\u231b\u23cf\u23e9\u24c1\u24c2\u3000\U0001f600\U0010ffffeio"
    texts = ["", " ", "  ", "\t", "a", "ÀÉ aé", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in [None, *texts]], "t string")
    got = df.select("t", X.collapse_ws("t").alias("ws"), X.remove_emojis("t").alias("em"), X.emoji_count("t").alias("n"),
                    X.syllable_count("t").alias("s"), X.ws_tokens("t").alias("k")).collect()
    ws, em, vowels = (re.compile(plain(p)) for p in (P.WS_RUN, P.EMOJI_CLASS + "+", P.SYLLABLE))
    for r in got:
        if r.t is None:
            assert tuple(r) == (None, None, None, 0, 0, [])
        else:
            assert tuple(r)[1:] == (ws.sub(" ", r.t), em.sub("", r.t), len(em.findall(r.t)), len(vowels.findall(r.t.lower())),
                                    [k for k in re.split("[ \t\n]+", r.t.lower()) if k])
