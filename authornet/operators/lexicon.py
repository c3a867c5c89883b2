"""Category-lexicon engine (L1-L10) and the token lookups that share it
(T10 part-of-speech counts, T11 polarity, P23 lemmas).

Matching rule per whitespace token (lower-cased, punctuation kept):
an exact dictionary word wins and counts once for each of its categories;
otherwise the *longest* ``stem*`` that is a prefix of the token wins, across
all categories, so a longer non-target stem shadows a shorter target one.

Two physical plans give the same result:

* ``inline`` (default for a bounded lexicon, size checked): the lexicon
  becomes hashed ``IN`` sets inside higher-order array expressions.  Each
  message is scored in the projection that reads it: no explode, no
  shuffle, the text never leaves its partition.
* ``join`` (any size): messages are tokenised once into a stored table; its
  *distinct vocabulary* is matched once (exact equi-join, then generated prefixes
  equi-joined with the stems - never a LIKE theta join), and the matches are joined to
  the token counts per message.  AQE measures the sides and broadcasts or splits.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage

# Inline plan limit in bytes: the lexicon then travels as hashed sets in the plan, with every task.
MAX_INLINE_BYTES = 1 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of a lookup table: by the optimiser's statistics where they already
    say that it is small, else measured (one aggregate, nothing collected)."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known <= MAX_INLINE_BYTES:
        return known
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return df.agg(F.sum(width + F.lit(8))).first()[0] or 0


def fits_inline(df: DataFrame) -> bool:
    return table_bytes(df) <= MAX_INLINE_BYTES


def bounded_rows(df: DataFrame):
    """All rows of a lookup table whose size was measured first."""
    size = table_bytes(df)
    if size > MAX_INLINE_BYTES:
        raise ValueError(f"a lookup table of {size} bytes does not fit inline; use the join plan")
    return df.collect()


# --- L1-L4 lexicon table operators ------------------------------------------

def explode_lexicon(wide: DataFrame) -> DataFrame:
    """L1: (word, categories array<int>) -> one row per (word, category id)."""
    return wide.select("word", F.explode("categories").alias("categories")) \
        .withColumn("categories", F.col("categories").cast("int"))


def name_categories(long: DataFrame, names: DataFrame) -> DataFrame:
    """L2: attach category names from an (id, name) table (68 rows in the
    reference; a fixed-size broadcast)."""
    n = names.select(F.col("categories").cast("int").alias("categories"), "cat_name")
    return long.join(F.broadcast(n), "categories", "inner").select("word", "cat_name", "categories")


def sort_lexicon(long: DataFrame) -> DataFrame:
    """L3."""
    return long.orderBy("cat_name", "word")


def filter_targets(df: DataFrame, targets=P.LEXICON_TARGETS, col: str = "cat_name") -> DataFrame:
    """L4 (apply after matching so non-target entries still shadow)."""
    return df.filter(F.col(col).isin(list(targets)))


def tokenize(df: DataFrame, key: str = "UID_key", text: str = "final_message_string") -> DataFrame:
    """One row per whitespace token."""
    return df.select(key, F.explode(X.ws_tokens(text)).alias("tok"))


def _split(lexicon: DataFrame):
    lex = lexicon.select(F.lower("word").alias("word"), "cat_name").distinct()
    is_stem = F.col("word").endswith("*")
    exact = lex.filter(~is_stem)
    stems = lex.filter(is_stem).select(F.expr("substring(word, 1, length(word) - 1)").alias("stem"), "cat_name")
    return exact, stems


# --- L6/L7 join plan --------------------------------------------------------

def match_exact(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(tok, cat_name) for tokens that are exact dictionary words."""
    exact, _ = _split(lexicon)
    return tokens.select("tok").distinct().join(exact.withColumnRenamed("word", "tok"), "tok")


def match_prefix(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(tok, cat_name) via the longest stem, for tokens with no exact
    entry.  Prefixes are generated for distinct tokens only."""
    exact, stems = _split(lexicon)
    vocab = tokens.select("tok").distinct().join(exact.select(F.col("word").alias("tok")).distinct(), "tok", "left_anti")
    longest = stems.agg(F.max(F.length("stem"))).first()[0] or 0
    pfx = vocab.select("tok", F.explode(F.when(F.lit(longest > 0) & (F.length("tok") > 0), F.sequence(
        F.lit(1), F.least(F.length("tok"), F.lit(longest))))).alias("n")).withColumn("stem", F.expr("substring(tok, 1, n)"))
    best = pfx.join(stems.select("stem").distinct(), "stem").groupBy("tok").agg(F.max("n").alias("n"))
    return best.withColumn("stem", F.expr("substring(tok, 1, n)")).join(stems, "stem").select("tok", "cat_name")


def token_counts(base: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tok, n) of a stored table with a token array: summed inside each
    task before the shuffle, so a word repeated in a message is one row."""
    return base.select(key, F.explode(tokens).alias("tok")).groupBy(key, "tok").agg(F.count(F.lit(1)).alias("n"))


def lexicon_hits_join(base: DataFrame, lexicon: DataFrame, key: str = "UID_key", tokens: str = "_toks",
                      targets=P.LEXICON_TARGETS) -> DataFrame:
    """(key, cat_name, hits) for the target categories, join plan, from a stored
    table with a token array."""
    vocab = cut_lineage(base.select(F.explode(tokens).alias("tok")).distinct())
    matched = filter_targets(match_exact(vocab, lexicon).unionByName(match_prefix(vocab, lexicon)), targets)
    return (token_counts(base, key, tokens).join(matched, "tok")
            .groupBy(key, "cat_name").agg(F.sum("n").alias("hits")))


# --- inline plan --------------------------------------------------------------

class InlineLexicon:
    """A size-checked lexicon compiled into hashed ``IN`` sets."""

    def __init__(self, lexicon: DataFrame):
        self.exact_by_cat = defaultdict(set)
        self.stem_by_cat = defaultdict(set)
        for word, cat in bounded_rows(lexicon.select(F.lower("word").alias("word"), "cat_name")):
            if word.endswith("*"):
                self.stem_by_cat[cat].add(word[:-1])
            else:
                self.exact_by_cat[cat].add(word)
        self.exact_words = sorted(set().union(*self.exact_by_cat.values())) if self.exact_by_cat else []
        self.stems = sorted(set().union(*self.stem_by_cat.values())) if self.stem_by_cat else []
        self.maxlen = max((len(s) for s in self.stems), default=0)

    def _in(self, c: Column, values) -> Column:
        return c.isin(sorted(values)) if values else F.lit(False)

    def entry_keys(self, tokens: Column) -> Column:
        """Map each token to the dictionary entry that catches it:
        '=word' (exact), '*stem' (longest stem) or null."""
        def key(t):
            if self.maxlen:
                lens = F.sequence(F.least(F.length(t), F.lit(self.maxlen)), F.lit(1), F.lit(-1))
                n = F.try_element_at(F.filter(lens, lambda k: self._in(F.substring(t, 1, k), self.stems)), F.lit(1))
                stem_key = F.concat(F.lit("*"), F.substring(t, 1, n))
            else:
                stem_key = F.lit(None).cast("string")
            return F.when(self._in(t, self.exact_words), F.concat(F.lit("="), t)).otherwise(stem_key)
        return F.transform(tokens, key)

    def category_hits(self, keys: Column, cat: str) -> Column:
        wanted = {"=" + w for w in self.exact_by_cat.get(cat, ())} | {"*" + s for s in self.stem_by_cat.get(cat, ())}
        return F.size(F.filter(keys, lambda k: F.coalesce(self._in(k, wanted), F.lit(False)))).cast("bigint")

    def target_masks(self, tokens: Column, targets) -> Column:
        """Per token that counts for a target, the bits of its targets; the same entry catches it as in
        :meth:`entry_keys`.  A prefix is looked up among the stems of its own length only, the longest first, so a token is
        a chain of set lookups."""
        bits = lambda by_cat, word: sum(1 << i for i, c in enumerate(targets) if word in by_cat.get(c, ()))

        def grouped(words, by_cat):
            out = defaultdict(set)
            for w in words:
                out[bits(by_cat, w)].add(w)
            return sorted(out.items(), reverse=True)

        def mask(t):
            def first_of(chain, out):
                for c, ws, m in reversed(chain):
                    out = F.when(self._in(c, ws), F.lit(m)).otherwise(out)
                return out

            sizes = sorted({len(w) for w in self.stems if w}, reverse=True)
            by_stem = first_of([(F.substring(t, 1, n), ws, m) for n in sizes
                                for m, ws in grouped([w for w in self.stems if len(w) == n], self.stem_by_cat)], F.lit(0))
            return first_of([(t, ws, m) for m, ws in grouped(self.exact_words, self.exact_by_cat)], by_stem)

        heads = sorted({w[:least] for w in self.stems if w}) if (least := min((len(w) for w in self.stems if w), default=0)) else []
        caught = F.filter(tokens, lambda t: self._in(t, self.exact_words) | self._in(F.substring(t, 1, least), heads))
        return F.filter(F.transform(caught, mask), lambda m: m != 0)


def lexicon_rates(df: DataFrame, lexicon: DataFrame, targets=P.LEXICON_TARGETS, mode: str = "ratio",
                  text: str = "final_message_string", plan: str = "auto", key: str = "UID_key",
                  prefix: str = "liwc_", carry=None) -> DataFrame:
    """Per message, hits / tokens (``mode='ratio'``, 0 without
    tokens) or raw hits (``mode='count'``), one ``liwc_<Cat>`` column per
    target.  Keeps every input row and the columns ``carry`` (default: all).
    ``plan='auto'`` takes the inline plan when the lexicon's measured size is at most
    ``MAX_INLINE_BYTES``, the join plan otherwise; both give the same result."""
    if plan == "auto":
        plan = "inline" if fits_inline(lexicon.select("word", "cat_name")) else "join"
    carry = list(carry) if carry is not None else df.columns
    if plan == "inline":
        lex = InlineLexicon(lexicon)
        toks = X.ws_tokens(text)
        tmp = df.withColumn("_toks", toks)
        tmp = tmp.withColumns({"_masks": lex.target_masks(F.col("_toks"), list(targets)), "_ntok": F.size("_toks")})
        hits = {c: _with_bit("_masks", i) for i, c in enumerate(targets)}
    else:
        # tokenised once and stored: the vocabulary, the counts and the result all read this table; its own
        # row numbers, as the caller's keys may repeat or be null
        base = cut_lineage(df.select(*carry, F.monotonically_increasing_id().alias("_row"), X.ws_tokens(text).alias("_toks")))
        wide = pivot_rates(lexicon_hits_join(base, lexicon, "_row", "_toks", targets), targets, "_row", prefix)
        tmp = base.withColumn("_ntok", F.size("_toks")).join(wide, "_row", "left")
        hits = {c: F.coalesce(F.col(prefix + c), F.lit(0).cast("bigint")) for c in targets}
    return tmp.select(*carry, *[_rate(hits[c], F.col("_ntok"), mode).alias(prefix + c) for c in targets])


def _with_bit(masks: str, i: int) -> Column:
    return F.size(F.filter(masks, lambda m: m.bitwiseAND(F.lit(1 << i)) != 0)).cast("bigint")


def _rate(hits: Column, ntok: Column, mode: str) -> Column:
    if mode == "count":
        return hits.cast("bigint")
    return F.when(ntok > 0, hits / ntok).otherwise(F.lit(0.0))


def pivot_rates(hits: DataFrame, targets=P.LEXICON_TARGETS, key: str = "UID_key", prefix: str = "liwc_") -> DataFrame:
    """Long (key, cat_name, hits) -> one column per target (listed
    values, so no extra pass to discover them)."""
    wide = hits.groupBy(key).pivot("cat_name", list(targets)).agg(F.sum("hits"))
    return wide.select(key, *[F.col(c).cast("bigint").alias(prefix + c) for c in targets])


# --- T10 / T11 token lookups (inline when measured small, else a join) ------------

def with_words(df: DataFrame, text: str = "final_message_string") -> DataFrame:
    """Word tokens computed once, shared by the POS and polarity lookups."""
    words = X.words_array(text)
    return df.withColumn("_words", F.when(X.has_text(text), words).otherwise(F.array().cast("array<string>")))


def _looked_up(df: DataFrame, lookup: DataFrame, aggs) -> DataFrame:
    """Join plan of a word lookup: per row, ``aggs`` over (n, value) of the words
    found.  The words are stored once with the rows they came from and a number of the row, as
    the caller's keys may repeat or be null."""
    base = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    hits = token_counts(base, "_row", "_words").join(lookup.distinct(), "tok")
    return base.join(hits.groupBy("_row").agg(*aggs), "_row", "left").drop("_row")


def pos_counts(df: DataFrame, pos_lexicon: DataFrame, text: str = "final_message_string",
               tags=(("NOUN", "noun_count"), ("VERB", "verb_count"), ("ADJ", "adj_count")),
               key: str = "UID_key", plan: str = "auto") -> DataFrame:
    """Noun / verb / adjective tokens per message via a (word, pos)
    table; 0 for no text.  A word with several entries of one tag counts once."""
    lookup = pos_lexicon.select(F.lower("word").alias("tok"), F.col("pos").alias("value"))
    tmp = df if "_words" in df.columns else with_words(df, text)
    if plan == "join" or plan == "auto" and not fits_inline(lookup):
        aggs = [F.sum(F.when(F.col("value") == tag, F.col("n"))).alias(out) for tag, out in tags]
        found = _looked_up(tmp, lookup, aggs)
        out = found.withColumns({o: F.coalesce(F.col(o), F.lit(0)).cast("bigint") for _, o in tags})
    else:
        by_tag = defaultdict(set)
        for w, p in bounded_rows(lookup):
            by_tag[p].add(w)

        def among(words, ws):
            return F.filter(words, lambda w: w.isin(sorted(ws)) if ws else F.lit(False))

        wanted = set().union(*(by_tag.get(tag, ()) for tag, _ in tags))  # one look at every word, three at those found
        tmp = tmp.withColumn("_found", among("_words", wanted))
        out = tmp.withColumns({o: F.size(among("_found", by_tag.get(tag, ()))).cast("bigint") for tag, o in tags}).drop("_found")
    return out if "_words" in df.columns else out.drop("_words")


def sentiment_flags(df: DataFrame, polarity: DataFrame, text: str = "final_message_string",
                    key: str = "UID_key", plan: str = "auto") -> DataFrame:
    """Sign of the summed word polarity -> exclusive 0/1 flags
    positive / negative / neutral; all null for no text.  Entries of one word add up."""
    lookup = polarity.select(F.lower("word").alias("tok"), F.col("score").cast("int").alias("value"))
    tmp = df if "_words" in df.columns else with_words(df, text)
    if plan == "join" or plan == "auto" and not fits_inline(lookup):
        summed = lookup.groupBy("tok").agg(F.sum("value").cast("int").alias("value"))
        found = _looked_up(tmp, summed, [F.sum(F.col("n") * F.col("value")).alias("_sum")])
        tmp = found.withColumn("_s", F.when(X.has_text(text), F.coalesce("_sum", F.lit(0)))).drop("_sum")
    else:
        scores, by_score = defaultdict(int), defaultdict(set)
        for w, s in bounded_rows(lookup):
            scores[w] += s
        for w, s in scores.items():
            by_score[s].add(w)

        def score_of(w):
            expr = F.lit(0)
            for s, ws in sorted(by_score.items()):
                expr = F.when(w.isin(sorted(ws)), F.lit(s)).otherwise(expr)
            return expr
        known = F.filter("_words", lambda w: w.isin(sorted(scores)) if scores else F.lit(False))
        score = F.aggregate(F.transform(known, score_of), F.lit(0), lambda acc, x: acc + x)
        tmp = tmp.withColumn("_s", F.when(X.has_text(text), score))
    flag = lambda cond: F.when(F.col("_s").isNull(), F.lit(None).cast("int")).otherwise(cond.cast("int"))
    out = tmp.withColumns({
        "positive_sentiment": flag(F.col("_s") > 0),
        "negative_sentiment": flag(F.col("_s") < 0),
        "neutral_sentiment": flag(F.col("_s") == 0),
    }).drop("_s")
    return out if "_words" in df.columns else out.drop("_words")
