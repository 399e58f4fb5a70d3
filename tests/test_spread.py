"""No round of communities sends vertices or links whole through the driver."""

import pytest

from rillworks.operators import graph, leiden


@pytest.mark.parametrize("module, run", [(leiden, lambda e: leiden.leiden(e, passes=1, rounds=2)), (graph, lambda e: graph.communities(e, 2))])
def test_rounds_join_by_shuffles(spark, monkeypatch, module, run):
    plans, write = [], module.cut

    def cut(rows, *name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, *name)

    monkeypatch.setattr(module, "cut", cut)
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 12, 1.0) for i in range(12)], "src long, dst long, weight double")
    assert run(edges).count() == 12
    assert len(plans) > 1 and not [x for x in plans if "BroadcastExchange" in x]  # before: written rows were sent to all, being small
