"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""
from collections import Counter

import pytest

import corpus_pipeline
from authornet.llm import common
from authornet.llm.queries import QUERIES

from .conftest import EDGE_ROWS

PER_PIECE = {"op1_packing"}
PER_PAGE = {"op11_html"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_edge_rows_each_get_their_row(spark, edge_dir, results, name):
    rows = results(name, edge_dir)
    ids = Counter(r["page_id" if name in PER_PAGE else "doc_id"] for r in rows)
    wanted = Counter(r[0] for r in EDGE_ROWS)
    if name in PER_PIECE:
        assert set(ids) == set(wanted)
    else:
        assert ids == wanted


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.columns and df.count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_rows_and_empty_tables(spark, edge_dir, empty_dir, name, stage):
    for path in (edge_dir, empty_dir):
        docs = common.documents(spark, path)
        out = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        n = out.count()
        assert n == 0 if path == empty_dir else n > 0


def test_pipeline_packs_what_the_stages_keep(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.write_shared(stage(spark, docs, sf), "test")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf).select("doc_id", "length", "ids").collect()
    assert {r["doc_id"] for r in out} == kept and 0 < len(kept) < 200
    assert all(len(r["ids"]) == 4 * r["length"] for r in out)
