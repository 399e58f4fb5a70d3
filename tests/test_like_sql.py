"""Rows on which queries once gave other results than their SQL."""

import datetime

import duckdb

from rillworks.plans import detect, finance


def same(spark, d, plans, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    got = plans.QUERIES[name](spark, str(d))
    want = con.execute(plans.ORACLES[name]).to_arrow_table().select(got.columns).to_pylist()
    rows = [r.asDict() for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


def test_boxes_without_area(spark, tmp_path):
    """Of quantity 1 and noise 10 the left and right sides of a box meet; two such boxes in an image have an overlap of 0 / 0."""
    rows = [(o, (o * 7 + n * 3) % 40, (o + n) % 40, n, 1.0) for o in range(1, 60) for n in range(1, 8)] + [(o, o % 40, o % 40, 3 * o % 11 + 11, 1.0) for o in range(1, 60)]
    rows += [(o, 2 * o % 40, o % 40, (10 - 3 * o) % 11 + k, 1.0) for o in range(1, 60) for k in (22, 33)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = same(spark, tmp_path, detect, "d3_nms", "lineitem")
    flat = detect.predicted(spark, str(tmp_path)).where("x2 <= x1 AND score >= 0.25").groupBy("image_id").count().where("count > 1")
    assert flat.count() > 0 and kept


def test_ratios_between_two_decimals(spark, tmp_path):
    """Debt over equity of 9 gives a bound of 0.85 * 9, which is 7.6499999999999995 as a double and 7.7 in SQL."""
    at = datetime.datetime(1996, 1, 1)
    spark.createDataFrame([(k, f"c{k}", 1, b, "X") for k, b in enumerate([1000.0, 1000.0, 1000.0, 500.0])], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k, "O", 1.0, at, "1") for k in range(4)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, 562500.0), (1, 562500.0), (2, 187500.0), (3, 968750.0)], "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("f18_merge_covenants", "f19_assess"):
        rows = same(spark, tmp_path, finance, name, "customer", "orders", "lineitem")
        assert any("Keep D/E at 7.7x" in r["covenants"] for r in rows)
