import pytest
from pyspark.sql import functions as F

from authornet.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = ("Alpha beta gamma delta. " * 3000) + "end"
PROSE = " ".join("kind" + "abcdefghij"[i % 10] + "klmno"[i // 10] + ("." if i % 9 == 8 else "") for i in range(50)) + "."
# every column may be null, rows repeat and tie, and extra columns bear the operators' own names
EDGE_ROWS = [
    (1, None, None, None), (2, "", "en", "s"), (3, "one", "en", "s"), (4, "two words", None, "s"), (5, LONG, "en", "s"),
    (5, LONG, "en", "s"), (6, LONG + " more", "en", "s"), (None, "no id here at all", "en", "s"), (None, None, None, None),
    (7, "\n \t\x0b ", "en", "s"), (8, "Mail jo@ex.org, call +1 (222) 333-4444 or 10.0.0.1\npassword = \"hunter2hunter2\"", "en", "s"),
    (8, "same id, other text", "en", "s"), (9, "ünïcödé 日本語 " * 30, "xx", "s"), (10, "tie", "en", "s"), (11, "tie", "en", "s"),
    (12, PROSE, "en", "s"), (13, PROSE, "en", "s"), (13, PROSE, "en", "s"),
]


def write_tables(spark, path, rows, labels=(), items=()):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    for extra in ("kept", "score", "row", "block", "h", "key", "one", "hits", "rank"):
        docs = docs.withColumn(extra, F.lit("x"))
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = spark.createDataFrame([(r[0], None if r[0] is None else f"https://h.example/{r[0]}", r[1]) for r in rows],
                                  "page_id bigint, url string, html string")
    pages.withColumn("row", F.lit("x")).coalesce(2).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    labels = [(3, 1, 0), (3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (9, 1, 0)]
    items = [(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma delta alpha"), (2, "Two Words"), (3, None), (4, "")]
    return write_tables(spark, tmp_path_factory.mktemp("edge") / "t", EDGE_ROWS, labels, items)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty") / "t", [])


@pytest.fixture(scope="session")
def results(spark):
    """Rows of a query over the smallest tables, computed once."""
    kept = {}

    def of(name, sf=SF):
        if (name, sf) not in kept:
            kept[name, sf] = [r.asDict() for r in QUERIES[name](spark, sf).collect()]
        return kept[name, sf]

    return of


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
