import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from authornet.llm import labels, quality_rank, quality_rules, sharding, toxicity
from authornet.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(results, texts):
    for r in results("op5_quality_rules"):
        n, *_, repeats = want = plain_counts(texts[r["doc_id"]])
        assert want == tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("text", ["a b c d e f g h " * 2, "a b c d e f g h i " * 3 + "a b c d e f g h", " x\n\nx \nx\n", "a " * 50, "\x0bq\x0c\r z"])
def test_repeats_and_lines(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = quality_rules.counts(df).first()
    assert plain_counts(text) == tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_rules_run_without_python(spark):
    from authornet.llm import common

    df = quality_rules.judge(common.texts(common.documents(spark, "/root/testdata/sf0.001")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan += quality_rules.counts(common.texts(common.documents(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rule_votes_agree_with_labels(spark):
    judged = QUERIES["op5_quality_rules"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    table = Counter((r["quality"], r["kept"]) for r in judged.filter("not base_failed").select("quality", "kept").collect())
    assert table[1, True] >= 0.99 * (table[1, True] + table[1, False])
    assert table[0, False] >= 0.9 * (table[0, True] + table[0, False])


def plain_em(votes, rounds):
    """The same estimate with a row per document and loops over rules and votes."""
    n, rules = votes.shape
    good = np.array([0.9 if k == 0 else 0.5 if k == 1 else 0.1 for k in (votes == -1).sum(axis=1)])
    ratio, s = quality_rules.ACCURACY / (1 - quality_rules.ACCURACY), quality_rules.SMOOTHING
    for _ in range(rounds):
        odds = np.zeros((rules, 3))
        for r in range(rules):
            share = np.array([(votes[:, r] == v).sum() for v in (-1, 0, 1)]) / n
            for c, tilt in ((good, 1 / ratio), (1 - good, ratio)):
                base = share * np.array([tilt, 1, 1])
                p = np.array([(c * (votes[:, r] == v)).sum() for v in (-1, 0, 1)]) + quality_rules.PRIOR / 2 * n * base / base.sum() + s
                odds[r] += (1 if c is good else -1) * np.log(p / p.sum())
        prior = np.log((good.sum() + s) / ((1 - good).sum() + s))
        good = 1 / (1 + np.exp(-(prior + sum(odds[r][votes[:, r] + 1] for r in range(rules)))))
    return prior, odds


def as_table(votes):
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    return patterns, n.astype(float)


def planted_votes(seed, n=6000, bad_share=0.2):
    """Votes of six rules of known accuracy, independent given the class."""
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < bad_share
    votes = np.ones((n, 6), dtype=int)
    for r, (hit, false) in enumerate([(0.7, 0.02), (0.6, 0.05), (0.5, 0.01), (0.8, 0.1), (0.4, 0.03), (0.3, 0.02)]):
        against = rng.random(n) < np.where(bad, hit, false)
        votes[:, r] = np.where(against, -1, np.where(rng.random(n) < 0.1, 0, 1))
    return votes, bad


def test_rule_weights_equal_plain_em(monkeypatch):
    votes, _ = planted_votes(1, 400)
    for rounds in (1, 2, 7):
        prior, odds = quality_rules.learn(*as_table(votes), rounds=rounds)
        want = plain_em(votes, rounds)
        assert abs(prior - want[0]) < 1e-9 and np.allclose(odds, want[1])


@pytest.mark.parametrize("seed, bad_share", [(1, 0.2), (2, 0.05), (3, 0.5)])
def test_planted_accuracies_are_found(seed, bad_share):
    votes, bad = planted_votes(seed, bad_share=bad_share)
    prior, odds = quality_rules.learn(*as_table(votes))
    good = prior + sum(odds[r][votes[:, r] + 1] for r in range(6)) > 0
    assert (good == ~bad).mean() > 0.93 and abs((~good).mean() - bad_share) < 0.05
    ranks = [float(odds[r][0]) for r in range(6)]
    assert ranks[2] == min(ranks) and all(o < 0 for o in ranks)  # the most precise rule weighs most
    assert quality_rules.learn(np.zeros((0, 6), int), np.zeros(0))[0] == 0.0


def toy_toxicity():
    rng = np.random.default_rng(8)
    plain, bad = [f"plain{chr(97 + i)}word" for i in range(20)], ["vileterm", "nastyterm", "foulterm"]
    rows = []
    for i in range(240):
        words = list(rng.choice(plain, 30))
        toxic = i % 4 == 0
        if toxic:
            words[10:13] = list(rng.choice(bad, 3))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_scores_equal_brute_force(spark):
    """Counts, log-odds, segments, calibration and logistic weights worked out text by text."""
    rows = toy_toxicity()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    train = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id bigint, y int")
    got = {r["doc_id"]: r["score"] for r in toxicity.detect(docs, train).collect()}
    uses, total = {}, np.zeros(3)
    for i, t, y in rows:
        for w, n in Counter(t.split()).items():
            for k in ({2} | ({1 - y} if i % 3 else set())):
                total[k] += min(n, 4)
                for e in toxicity.entries(w):
                    uses.setdefault(e, np.zeros(3))[k] += min(n, 4)
    uses = {e: v for e, v in uses.items() if v[0] + v[1] >= toxicity.MIN_USES}
    weight, score = toxicity.PRIOR_SHARE * (total[0] + total[1]), {}
    for e, v in uses.items():
        a, b = v[0] + weight * v[2] / total[2], v[1] + weight * v[2] / total[2]
        d = np.log(a / (total[0] + weight - a)) - np.log(b / (total[1] + weight - b))
        z = d / np.sqrt(1 / a + 1 / b)
        score[e] = d * max(0.0, 1 - 4 / z ** 2) - toxicity.DRIFT
    lexicon = toxicity.Lexicon(toxicity.count_entries(docs, train))
    assert set(lexicon.scores) == set(score) and all(abs(lexicon.scores[e] - s) < 1e-9 for e, s in score.items())
    lam, bests = lexicon.decay, {}
    for i, t, _ in rows:
        s = np.array([next((score[e] for e in toxicity.entries(w) if e in score), -toxicity.DRIFT) for w in t.split()])
        bests[i] = brute_segments(s)
    top = {i: max((v for *_, v in b), default=0.0) for i, b in bests.items()}
    clean = [i for i, _, y in rows if i % 3 and not y]
    log_k = np.log(len(clean) / sum(30 * np.exp(-lam * top[i]) for i in clean))
    room = log_k + np.log(30)
    x = {i: (min(max(lam * top[i] - room, -10), 30), np.log1p(sum(max(lam * v - room, 0) for *_, v in b))) for i, b in bests.items()}
    ids = [i for i, _, _ in rows if i % 3]
    w = toxicity.logistic(np.array([x[i] for i in ids]), np.array([float(y) for i, _, y in rows if i % 3]))
    for i in bests:
        assert abs(got[i] - 1 / (1 + np.exp(-(w[0] * x[i][0] + w[1] * x[i][1] + w[2])))) < 1e-6


def brute_segments(s):
    best, total = None, np.concatenate([[0], np.cumsum(s)])
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if total[j] - total[i] > (best[2] + 1e-9 if best else 1e-9):
                best = (i, j, total[j] - total[i])
    if best is None:
        return []
    i, j, _ = best
    return brute_segments(s[:i]) + [best] + [(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 3) + 0.0001), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores))
    want = brute_segments(np.array(scores))
    assert sum(v for *_, v in got) == pytest.approx(sum(v for *_, v in want))
    assert max((v for *_, v in got), default=0) == pytest.approx(max((v for *_, v in want), default=0))


def test_decay_solves_its_equation():
    s, p = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    lam = toxicity.decay(s, p)
    assert p @ np.exp(lam * s) == pytest.approx(1) and lam > 0


def held_out_auc(spark, name, label, sf=MEDIUM):
    rows = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", label, "predicted").collect()
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert ((0 <= s) & (s <= 1)).all()
    wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    return wins, np.mean([r[2] == r[1] for r in rows])


def test_toxicity_with_few_labels(spark):
    """37 toxic training texts are enough to find most of the others."""
    auc, _ = held_out_auc(spark, "op3_toxicity", "toxic", "/root/testdata/sf0.01")
    assert auc > 0.95


def test_toxicity_on_held_out_rows(spark):
    auc, accuracy = held_out_auc(spark, "op3_toxicity", "toxic")
    assert auc > 0.95 and accuracy > 0.97


def test_quality_on_held_out_rows(spark):
    auc, accuracy = held_out_auc(spark, "op10_quality_rank", "quality")
    assert auc > 0.98 and accuracy > 0.98


def test_folds_and_bounded_sample(spark):
    from pyspark.sql import functions as F

    ids = spark.range(50).select("id", labels.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)
    rows = labels.training_rows(spark, MEDIUM, "toxic", most=100)
    assert rows.count() == 100 and rows.filter(labels.held_out(F.col("doc_id"))).count() == 0


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    w = quality_rank.bradley_terry(x, *quality_rank.preference_pairs(y))
    s = x @ w
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.98 and w[0] > 0 > w[1]
    better, worse = quality_rank.preference_pairs(y)
    assert (y[better] == 1).all() and (y[worse] == 0).all() and len(better) <= 16 * min((y == 0).sum(), (y == 1).sum())


def test_shards(results, texts):
    rows = results("op9_sharding")
    slots = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hot_groups_are_split_and_shards_stay_equal(spark):
    rows = [(i, "hot text " * 20) for i in range(4000)] + [(i, f"text {i} " * (1 + i % 30)) for i in range(4000, 12000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    sizes = Counter()
    count = Counter()
    for r in sharding.shard(df, 10).collect():
        sizes[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    for c in (sizes, count):
        assert max(c.values()) < 1.03 * min(c.values()) and len(c) == 10


def test_equal_texts_share_a_shard(spark):
    df = spark.createDataFrame([(i, f"text {i % 1500} " * 5) for i in range(3000)], "doc_id bigint, text string")
    where = {}
    for r in sharding.shard(df, 10).join(df, "doc_id").collect():
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_quality_cut_is_the_quantile_of_all_documents(spark):
    """Labels come from a source of short texts only; the cut still rejects their share of all documents."""
    rng = np.random.default_rng(4)
    size = lambda k: int(rng.integers(3, 40) if k < 100 else rng.integers(200, 400))
    docs = spark.createDataFrame([(k, " ".join(["word", "some", "text", "here"][i % 4] for i in range(size(k)))) for k in range(1000)],
                                 "doc_id bigint, text string")
    lengths = {r["doc_id"]: len(r["text"].split()) for r in docs.filter("doc_id < 100").collect()}
    rows = spark.createDataFrame([(k, int(n >= 20)) for k, n in lengths.items()], "doc_id bigint, y int")
    share = sum(n < 20 for n in lengths.values()) / 100
    got = quality_rank.rank(docs, rows).filter(f"score < {quality_rank.PREDICT_FROM}").count() / 1000
    assert abs(got - share) < 0.05
