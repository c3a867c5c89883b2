"""Registered queries for file sources and sinks (S2, S4, S7) and the
model / centrality rows without a SQL twin (G11, D8, D9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import graph as G
from ..operators import stats as ST
from ..session import scratch_path
from ..sources import sinks
from ..sources.tables import read_lexicon_dic, table
from . import sqltwin as S
from .authors import clean_messages, narrow_messages, round_doubles
from .catalog import register
from .q_lexicon import VOCAB_LEX_SQL, vocab_lexicon

LATIN1 = r"^[\x{1}-\x{FF}]+$"


@register("s2_read_lexicon_dic", S.with_ctes(VOCAB_LEX_SQL) + f"SELECT word, categories FROM vlex WHERE regexp_matches(word, {S.q(LATIN1)})")
def q_s2(spark, sf):
    """Write the corpus-derived lexicon as a Latin-1 ``.dic`` (metadata block
    of category names between '%' lines, then word<TAB>ids) and read it back."""
    lex = vocab_lexicon(spark, sf).filter(F.col("word").rlike(P.java(LATIN1)))
    entries = lex.select(F.concat_ws("\t", F.col("word"), F.array_join(F.col("categories"), "\t")).alias("line"))
    header = spark.createDataFrame([("%",)] + [(f"{i}\t{n}",) for i, n in enumerate(P.CATEGORY_NAMES, 1)] + [("%",)],
                                   "line string")
    path = scratch_path(spark, "s2")
    (header.unionByName(entries).write.option("encoding", "ISO-8859-1").option("sep", "\u0001")
     .option("quote", "\u0000").option("escape", "\u0000").option("header", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_lexicon_dic(spark, path)


@register("s4_write_id_text", S.with_ctes(*S.BASE) + "SELECT UID_key, CASE WHEN coalesce(final_message_string, '') = '' THEN NULL ELSE final_message_string END AS text FROM clean")
def q_s4(spark, sf):
    path = scratch_path(spark, "s4")
    sinks.write_id_text(clean_messages(spark, sf), path)
    back = (spark.read.option("sep", "\t").option("quote", "\u0000").option("header", False)
            .schema("UID_key long, text string").csv(path))
    return back


@register("s7_save_matrix", S.rounded(["src", "dst", "w"], {"w"}, __import__("authornet.plans.q_graph", fromlist=["GRAPH_SQL"]).GRAPH_SQL + "SELECT src, dst, w FROM adjn"))
def q_s7(spark, sf):
    mem = G.memberships(narrow_messages(spark, sf))
    adj = G.normalize_adj(G.pair_weights(G.author_pairs(mem)), mem)
    path = scratch_path(spark, "s7")
    sinks.save_matrix(adj, path)
    return round_doubles(spark.read.parquet(path))


def _betweenness_sql() -> str:
    """Pairs with d(s, v) + d(v, t) = d(s, t), weighted by their share of the paths."""
    from .q_graph import GRAPH_SQL
    return S.rounded(["author", "betweenness_centrality"], {"betweenness_centrality"}, GRAPH_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
walk(s, a, d) AS (SELECT author, author, 0 FROM nodes
  UNION SELECT w.s, y.dst, w.d + 1 FROM walk w JOIN sym y ON w.a = y.src WHERE w.d < (SELECT least(12, count(*)) FROM nodes)),
dist AS (SELECT s, a, min(d) AS d FROM walk GROUP BY s, a),
sg AS (SELECT s, a, d, CAST(1 AS DOUBLE) AS n FROM dist WHERE d = 0
  UNION ALL SELECT g.s, y.dst, g.d + 1, sum(g.n) FROM sg g JOIN sym y ON g.a = y.src JOIN dist t ON t.s = g.s AND t.a = y.dst AND t.d = g.d + 1
  GROUP BY g.s, y.dst, g.d + 1),
b AS (SELECT x.a AS v, sum(x.n * y.n / z.n) AS b FROM sg x JOIN sg y ON y.s = x.a JOIN sg z ON z.s = x.s AND z.a = y.a AND z.d = x.d + y.d
  WHERE x.d > 0 AND y.d > 0 GROUP BY x.a)
SELECT n.author, coalesce(b.b, 0) / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)) AS betweenness_centrality
FROM nodes n LEFT JOIN b ON b.v = n.author""")


@register("g11_betweenness", _betweenness_sql())
def q_g11(spark, sf):
    from .authors import narrow_messages
    mem = G.memberships(narrow_messages(spark, sf))
    edges = G.pair_weights(G.author_pairs(mem))
    return round_doubles(G.betweenness(edges, mem.select("author").distinct()))


def _model(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    emb = ST.split(emb, "vec_id")
    train = emb.filter(~F.col("is_test"))
    w = ST.class_weights(train, "label").select("label", "weight")
    model = ST.fit_multinomial(train.join(F.broadcast(w), "label"), "x", "label", "weight")  # K rows broadcast
    return model, emb


@register("d8_fit_multinomial")
def q_d8(spark, sf):
    model, _ = _model(spark, sf)
    rows = [(int(k), float(model.interceptVector[k]), [float(v) for v in model.coefficientMatrix.toArray()[k]])
            for k in range(model.coefficientMatrix.numRows)]
    return round_doubles(spark.createDataFrame(rows, "class int, intercept double, coefficients array<double>"))


@register("d9_predict")
def q_d9(spark, sf):
    model, emb = _model(spark, sf)
    pred = ST.predict(model, emb.filter(F.col("is_test")), "x", "vec_id")
    return pred.join(emb.select("vec_id", "label"), "vec_id")


@register("s3_write_table", S.with_ctes(*S.BASE) + """
SELECT author, group_name, CAST(sum(own_message) AS BIGINT) AS own_message,
  CAST(sum(forwarded_message) AS BIGINT) AS forwarded_message, CAST(count(UID_key) AS BIGINT) AS total_message_count
FROM clean WHERE author IS NOT NULL AND group_name IS NOT NULL GROUP BY author, group_name""")
def q_s3(spark, sf):
    """S3: a result table written as Parquet and read back."""
    from ..operators import aggregate as A
    path = scratch_path(spark, "s3")
    sinks.write_table(A.message_counts(clean_messages(spark, sf)), path)
    return spark.read.parquet(path)
