"""Feature queries over customers, documents' labels, lines and vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as f
from .finance import table
from .search import points

_EDGES = [0.0, 1000.0, 2500.0, 5000.0, 7500.0]


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment", "c_nationkey", "CASE WHEN c_custkey % 19 > 0 THEN c_acctbal END AS v", "CASE WHEN c_custkey % 23 > 0 THEN cast(c_acctbal + c_custkey % 4000 > 5000 as int) END AS y")


def m1_woe_iv(spark: SparkSession, d: str) -> DataFrame:
    return f.woe_table(_customers(spark, d), "v", "y", _EDGES).select("bin", "n", "bad", *(F.round(c, 6).alias(c) for c in ("rate", "woe", "iv")))


def m1_monotone_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins whose rates rise, from the data, with their weights of evidence."""
    rows = _customers(spark, d)
    return f.woe_table(rows, "v", "y", f.monotone_edges(rows, "v", "y"))


def m2_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return f.stratified_folds(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


def m3_target_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = f.stratified_folds(_customers(spark, d).select("c_custkey", "c_nationkey", "y"), "y", "c_custkey")
    return f.target_encoding(rows, "c_nationkey", "y").select("c_custkey", "fold", F.round("encoded", 8).alias("encoded"))


def m4_smote(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).withColumnRenamed("doc_id", "id")
    out = f.smote(rows, F.col("label") == 3, 2)
    return out.select("id", "other", "copy", F.round("share", 8).alias("share"), F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


def m5_imputation(spark: SparkSession, d: str) -> DataFrame:
    """One round over two columns, which SQL can say too."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS a", "CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice END AS b")
    return f.impute(rows, ["a", "b"], 1, 0.0).select("id", F.round("a", 4).alias("a"), F.round("b", 2).alias("b"))


QUERIES = {q.__name__: q for q in (m1_woe_iv, m1_monotone_bins, m2_stratified_folds, m3_target_encoding, m4_smote, m5_imputation)}

_CUSTOMERS = "cust AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 19 > 0 THEN c_acctbal END AS v, CASE WHEN c_custkey % 23 > 0 THEN CAST(c_acctbal + c_custkey % 4000 > 5000 AS INT) END AS y FROM customer)"
_UNIFORM = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296e0"

ORACLES = {
    "m1_woe_iv": f"WITH {_CUSTOMERS}, b AS (SELECT CASE WHEN v IS NULL THEN 6 ELSE (v >= 0)::INT + (v >= 1000)::INT + (v >= 2500)::INT + (v >= 5000)::INT + (v >= 7500)::INT END AS bin, y FROM cust WHERE y IS NOT NULL), c AS (SELECT bin, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS bad FROM b GROUP BY 1), "
    "p AS (SELECT *, (bad + 0.5e0) / (SUM(bad) OVER () + 3.5e0) AS p, (n - bad + 0.5e0) / (SUM(n - bad) OVER () + 3.5e0) AS q FROM c) SELECT bin, n, bad, ROUND(bad / n, 6) AS rate, ROUND(ln(p / q), 6) AS woe, ROUND(SUM((p - q) * ln(p / q)) OVER (), 6) AS iv FROM p",
    "m2_stratified_folds": "SELECT doc_id, source, CAST((row_number() OVER (ORDER BY source NULLS FIRST, md5('fold:' || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM documents",
    "m3_target_encoding": f"WITH {_CUSTOMERS}, r AS (SELECT *, CAST((row_number() OVER (ORDER BY y NULLS FIRST, md5('fold:' || c_custkey), c_custkey) - 1) % 5 AS INT) AS fold FROM cust), "
    "o AS (SELECT a.fold, AVG(b.y) AS prior FROM range(5) a(fold) JOIN r b ON b.fold <> a.fold GROUP BY 1), e AS (SELECT a.c_custkey, a.fold, COUNT(b.y) AS n, COALESCE(SUM(b.y), 0) AS s FROM r a LEFT JOIN r b ON a.c_nationkey = b.c_nationkey AND b.fold <> a.fold GROUP BY 1, 2) "
    "SELECT c_custkey, e.fold, ROUND((s + 10 * prior) / (n + 10), 8) AS encoded FROM e JOIN o USING (fold)",
    "m4_smote": f"WITH m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE label = 3), n AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY ROUND(list_cosine_similarity(a.x, b.x), 6) DESC, b.id) AS r FROM m a JOIN m b ON a.id <> b.id), "
    f"k AS (SELECT id, list(other ORDER BY r) AS near FROM n WHERE r <= 5 GROUP BY 1), d AS (SELECT id, j AS copy, near[CAST(floor({_UNIFORM.format("concat_ws(':', 0, id, j, 'near')")} * len(near)) AS INT) + 1] AS other, {_UNIFORM.format("concat_ws(':', 0, id, j, 'share')")} AS share FROM k, range(1, 3) c(j)) "
    "SELECT d.id, other, CAST(copy AS INT) AS copy, ROUND(share, 8) AS share, ROUND(a.x[1] + share * (b.x[1] - a.x[1]), 6) AS first, ROUND(a.x[64] + share * (b.x[64] - a.x[64]), 6) AS last FROM d JOIN m a ON a.id = d.id JOIN m b ON b.id = other",
    "m5_imputation": "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice END AS b FROM lineitem), f AS (SELECT *, COALESCE(a, (SELECT AVG(a) FROM r)) AS fa, COALESCE(b, (SELECT AVG(b) FROM r)) AS fb FROM r), "
    "k AS (SELECT regr_slope(a, fb) FILTER (a IS NOT NULL) AS sa, regr_intercept(a, fb) FILTER (a IS NOT NULL) AS ia, regr_slope(b, fa) FILTER (b IS NOT NULL) AS sb, regr_intercept(b, fa) FILTER (b IS NOT NULL) AS ib FROM f) SELECT id, ROUND(COALESCE(a, ia + sa * fb), 4) AS a, ROUND(COALESCE(b, ib + sb * fa), 2) AS b FROM f, k",
}
