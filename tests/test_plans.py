"""Plan guards: no query may plan a cartesian product or a nested-loop
join, and Python runs only in the batch scorer (T13)."""
import pytest

import __spark_entry__ as E
from authornet.plans import catalog

SF = "/root/testdata/sf0.001"
# iterative operators execute while their plan is built; they are covered by
# unit tests and by the oracle/rows checks
ITERATIVE = {"g10_closeness", "g11_betweenness", "g12_eigenvector", "n14_refine_centres", "s8_log_metrics",
             "n5_encode", "n6_score_authors", "n13_scored_authors", "d8_fit_multinomial", "d9_predict",
             "c5_project_2d"}
PYTHON_OK = {"t13_score_batches", "t12_text_toxicity"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ITERATIVE])
def test_plan_has_no_cross_join(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    if name not in PYTHON_OK:
        assert not any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")), name
