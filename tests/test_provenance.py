"""Facts aren't dealt by their few labels and concepts."""

from rillworks.operators import risk


def test_short_lists_are_sent_to_the_facts(spark):
    facts = spark.range(100).selectExpr("id AS company", "1 AS period", "id AS fact_id", "'Revenue' AS label", "1 AS page", "1e0 AS value")
    named = risk.map_concepts(facts, spark.createDataFrame([("revenue", "REVENUE")], "alias string, concept string"))
    out = risk.provenance(spark.createDataFrame([("margin", "REVENUE")], "metric string, concept string"), named)
    assert out.count() == 100 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
