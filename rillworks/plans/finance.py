"""Finance queries over companies made of customers and their orders."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as f
from ..operators import risk as r

#: Company columns over customer (c_*), revenue and n_orders; the same text in Spark and in DuckDB.
COLUMNS = {
    "company": "c_custkey", "revenue": "revenue", "working_capital": "c_acctbal * 2e0", "total_assets": "CASE WHEN c_custkey % 50 = 0 THEN 0e0 ELSE revenue * 0.8e0 + 1e3 END",
    "retained_earnings": "c_acctbal * 3e0", "ebit": "revenue * 0.1e0 + c_acctbal", "market_cap": "n_orders * 1e4", "total_liabilities": "CASE WHEN c_custkey % 37 = 0 THEN 0e0 ELSE revenue * 0.5e0 + 10e0 END",
    "net_operating_income": "revenue * 0.11e0 - c_acctbal", "annual_debt_service": "CASE WHEN c_custkey % 41 = 0 THEN 0e0 ELSE revenue * 0.08e0 + 1e2 END", "total_debt": "revenue * 0.4e0",
    "total_equity": "c_acctbal * 25e0", "cash_and_equivalents": "abs(c_acctbal)", "short_term_investments": "(c_custkey % 17) * 1e2", "accounts_receivable": "revenue * 0.05e0",
    "current_liabilities": "CASE WHEN c_custkey % 43 = 0 THEN 0e0 ELSE revenue * 0.06e0 + 1e3 END", "current_assets": "revenue * 0.07e0 + abs(c_acctbal)", "inventory": "revenue * 0.04e0",
    "cost_of_sales": "revenue * 0.7e0", "accounts_payable": "revenue * 0.03e0", "gross_profit": "revenue * 0.3e0", "ebitda": "revenue * 0.15e0 + c_acctbal", "net_income": "revenue * 0.05e0 + c_acctbal",
    "interest_expense": "(c_custkey % 9) * 53.7e0", "cfo": "revenue * 0.2e0 + c_acctbal * 3e0 - 5e2", "loan_amount": "CASE WHEN c_custkey % 29 = 0 THEN 0e0 WHEN c_custkey % 31 = 0 THEN 12e9 ELSE revenue * 0.6e0 + (c_custkey % 13) * 1e4 + 1e0 END",
    "loan_term_months": "12 * (c_custkey % 6)", "interest_rate": "(c_custkey % 12) * 1e0", "collateral_value": "CASE WHEN c_custkey % 23 = 0 THEN 0e0 ELSE floor(revenue) + (c_custkey % 11) * 1e4 END",
    "collateral_type": "CASE c_mktsegment WHEN 'BUILDING' THEN ' Real_Estate' WHEN 'MACHINERY' THEN 'machinery' WHEN 'FURNITURE' THEN 'SECURITIES ' ELSE c_mktsegment END", "haircut": "(c_custkey % 5) * 0.1e0",
}

_BASE = (
    "companies AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM (SELECT c.*, COALESCE(o.revenue, 0e0) AS revenue, COALESCE(o.n_orders, 0) AS n_orders FROM customer c "
    "LEFT JOIN (SELECT o_custkey, ROUND(SUM(l_extendedprice), 2) AS revenue, COUNT(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) o ON o_custkey = c_custkey))"
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def companies(spark: SparkSession, d: str) -> DataFrame:
    """One row for each customer, from sums over its orders."""
    sold = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    sold = table(spark, d, "orders").join(sold, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum("s"), 2).alias("revenue"), F.count("*").alias("n_orders"))
    rows = table(spark, d, "customer").join(sold, F.col("o_custkey") == F.col("c_custkey"), "left").na.fill({"revenue": 0.0, "n_orders": 0})
    return rows.selectExpr(*(f"{v} AS {k}" for k, v in COLUMNS.items()))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Long facts: for each customer and year of orders four concepts, one of them twice with other confidence, some left out."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    rows = o.select("company", "period", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.expr(v).alias("value"), F.expr(conf).alias("confidence")) for k, label, v, conf in FACTS))).alias("e"))
    rows = rows.select("company", "period", F.expr("(company * 10000 + period) * 10 + e.k").alias("fact_id"), "e.label", "e.value", "e.confidence", F.expr("cast(e.k + period % 7 as int)").alias("page"))
    return rows.where("NOT (label = 'EBIT' AND company % 6 = 0)")


#: k, label, value, confidence
FACTS = [(1, " Net Revenue", "total", "0.9e0"), (2, "revenue", "total * 1.01e0", "0.5e0 + (company % 5) * 0.1e0"), (3, "Total Debt", "total * 0.4e0", "0.8e0"), (4, "EBIT", "total * 0.1e0 - n", "0.7e0"), (5, "Footnote", "n * 1e0", "0.2e0")]
ALIASES = {"net revenue": "REVENUE", "revenue": "REVENUE", "total debt": "DEBT", "ebit": "EBIT"}
_FACTS = (
    "raw AS (SELECT o_custkey AS company, year(o_orderdate) AS period, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders GROUP BY 1, 2), "
    "labelled AS (" + " UNION ALL ".join(f"SELECT company, period, (company * 10000 + period) * 10 + {k} AS fact_id, '{label}' AS label, {v} AS value, {c} AS confidence, {k} + period % 7 AS page FROM raw" for k, label, v, c in FACTS) + "), "
    "facts AS (SELECT l.*, a.concept FROM labelled l LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items()) + ") a(alias, concept) ON lower(trim(label)) = alias WHERE NOT (label = 'EBIT' AND company % 6 = 0))"
)


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return r.map_concepts(facts(spark, d), spark.createDataFrame(list(ALIASES.items()), "alias string, concept string"))


def _of(name: str, *fields: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return companies(spark, d).select("company", f.FORMULAS[name]().alias("s")).select("company", *(F.col(f"s.{x}").alias(x.replace("terms.", "")) for x in fields))

    return query


_SIMPLE = [k for k in f.FORMULAS if k not in ("altman_z", "dscr", "pro_forma_dscr", "debt_to_equity", "quick_ratio", "ltv")]


def f7_f12_ratios(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).select("company", *(f.FORMULAS[k]().alias(k) for k in _SIMPLE))


def f13_rule_score(spark: SparkSession, d: str) -> DataFrame:
    return r.metrics(companies(spark, d)).select("company", f.rule_score().alias("s")).select("company", "s.score", F.array_join("s.rules", "|").alias("rules"))


def f19_assess(spark: SparkSession, d: str) -> DataFrame:
    """F13 to F19 in one projection; qualitative points from the customer's number."""
    out = r.assess(companies(spark, d), F.expr("cast(company % 30 as double)"))
    return out.select("company", "rule_points", "final_points", "level", "authority", "human_review", F.array_join("covenants", "|").alias("covenants"))


def f18_merge_covenants(spark: SparkSession, d: str) -> DataFrame:
    out = r.assess(companies(spark, d))
    given = F.when(F.col("company") % 3 == 0, F.array(F.lit("route 70% of revenue or more through our accounts"), F.lit("Pledge of shares")))
    return out.select("company", F.array_join(f.merge_covenants(given, F.col("covenants"), 4), "|").alias("covenants"))


def f20_map_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).groupBy("concept").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


def f21_facts_to_wide(spark: SparkSession, d: str) -> DataFrame:
    return r.facts_to_wide(concepts(spark, d), ["REVENUE", "DEBT", "EBIT"]).select("company", "period", *(F.round(c, 4).alias(c.lower()) for c in ("REVENUE", "DEBT", "EBIT")))


def f22_provenance(spark: SparkSession, d: str) -> DataFrame:
    inputs = spark.createDataFrame([("debt_to_revenue", "DEBT"), ("debt_to_revenue", "REVENUE"), ("margin", "EBIT"), ("margin", "REVENUE")], "metric string, concept string")
    out = r.provenance(inputs, concepts(spark, d))
    return out.select("company", "period", "metric", F.array_join(F.transform("inputs", lambda x: F.concat_ws(":", x["concept"], x["fact_id"].cast("string"), x["page"].cast("string"))), "|").alias("inputs"))


def f23_data_gaps(spark: SparkSession, d: str) -> DataFrame:
    return r.data_gaps(spark.createDataFrame([("REVENUE",), ("EBIT",), ("CFO",)], "concept string"), concepts(spark, d))


def f24_period_compare(spark: SparkSession, d: str) -> DataFrame:
    wide = concepts(spark, d).where("label = 'Total Debt'")
    return r.period_compare(wide).select("company", "period", F.round("prior", 2).alias("prior"), F.round("change", 2).alias("change"), "change_share")


def f25_cross_source_check(spark: SparkSession, d: str) -> DataFrame:
    a = concepts(spark, d).where("label IN ('Total Debt', 'EBIT')")
    b = a.where("fact_id % 11 <> 0").withColumn("value", F.expr("value * (1e0 + (company % 7) * 0.02e0)"))
    out = r.cross_source_check(a.where("fact_id % 13 <> 0"), b)
    return out.select("company", "concept", "period", "signal")


def f26_convert_currency(spark: SparkSession, d: str) -> DataFrame:
    src = "CASE company % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'VND' ELSE 'EUR' END"
    rows = companies(spark, d).selectExpr("company", "floor(revenue) AS revenue", f"{src} AS a", "CASE company % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'XXX' ELSE 'USD' END AS b")
    return rows.select("company", f.convert_currency(F.col("revenue"), F.col("a"), F.col("b")).alias("s")).select("company", "s.amount", "s.error")


def g9_related_parties(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 7 % 1000 + 1).alias("dst"))
    back = c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return r.related_parties(c.unionByName(back).where("src <> dst"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")))


QUERIES = {
    "f1_altman_z": _of("altman_z", "value", "verdict", "error", "terms.x1", "terms.x4"), "f2_dscr": _of("dscr", "value", "verdict", "error"), "f3_pro_forma_dscr": _of("pro_forma_dscr", "value", "verdict", "error", "annual_payment"),
    "f4_debt_to_equity": _of("debt_to_equity", "value", "verdict"), "f5_quick_ratio": _of("quick_ratio", "value", "verdict", "error"), "f6_ltv": _of("ltv", "value", "verdict", "error", "max_safe_loan"),
    **{q.__name__: q for q in (f7_f12_ratios, f13_rule_score, f18_merge_covenants, f19_assess, f20_map_concepts, f21_facts_to_wide, f22_provenance, f23_data_gaps, f24_period_compare, f25_cross_source_check, f26_convert_currency, g9_related_parties)},
}

_Z = "1.2e0 * working_capital / total_assets + 1.4e0 * retained_earnings / total_assets + 3.3e0 * ebit / total_assets + 0.6e0 * CASE WHEN total_liabilities > 0 THEN market_cap / total_liabilities ELSE 0e0 END + revenue / total_assets"
_BANDS = "CASE WHEN v >= 1.25e0 THEN 'ADEQUATE' WHEN v >= 1e0 THEN 'MARGINAL' WHEN v IS NOT NULL THEN 'INSUFFICIENT' END"
_CEIL = "CASE lower(trim(collateral_type)) WHEN 'real_estate' THEN 0.7e0 WHEN 'machinery' THEN 0.5e0 WHEN 'securities' THEN 0.6e0 ELSE 0.4e0 END"
_GUARD3 = "CASE WHEN cfo <= 0 THEN 'cash flow must be positive' WHEN loan_term_months <= 0 THEN 'term must be positive' WHEN interest_rate <= 0 THEN 'rate must be positive' WHEN loan_amount <= 0 THEN 'amount must be positive' END"
_PAY = "loan_amount * (interest_rate / 1200e0) * pow(1e0 + interest_rate / 1200e0, loan_term_months) / (pow(1e0 + interest_rate / 1200e0, loan_term_months) - 1e0)"
_METRICS = (
    _BASE + f", guarded AS (SELECT *, {_GUARD3} AS g3 FROM companies), paid AS (SELECT *, CASE WHEN g3 IS NULL THEN 12e0 * ({_PAY}) END AS pay FROM guarded), "
    f"m AS (SELECT *, CASE WHEN total_assets > 0 THEN ROUND({_Z}, 4) END AS z, CASE WHEN annual_debt_service > 0 THEN ROUND(net_operating_income / annual_debt_service, 4) END AS cover, "
    "CASE WHEN g3 IS NULL THEN ROUND(cfo / (annual_debt_service + pay), 4) END AS pro, CASE WHEN total_equity > 0 THEN ROUND(total_debt / total_equity, 4) END AS de, "
    "CASE WHEN current_liabilities > 0 THEN ROUND((cash_and_equivalents + short_term_investments + accounts_receivable) / current_liabilities, 4) END AS quick, "
    f"CASE WHEN loan_amount <= 0 OR collateral_value <= 0 THEN 'ERROR' WHEN loan_amount / collateral_value <= {_CEIL} THEN 'SAFE' WHEN loan_amount / collateral_value <= {_CEIL} * 1.15e0 THEN 'MARGINAL' ELSE 'BREACH' END AS ltv_status FROM paid), "
    "scored AS (SELECT *, LEAST(100e0, CASE WHEN pro < 1 THEN 45 WHEN pro < 1.25e0 THEN 20 ELSE 0 END + CASE WHEN cover < 1 THEN 40 WHEN cover < 1.25e0 THEN 15 ELSE 0 END + CASE WHEN z < 1.81e0 THEN 30 WHEN z < 2.99e0 THEN 10 ELSE 0 END "
    "+ CASE ltv_status WHEN 'BREACH' THEN 25 WHEN 'MARGINAL' THEN 10 ELSE 0 END + CASE WHEN de > 3 THEN 20 WHEN de > 2 THEN 8 ELSE 0 END + CASE WHEN quick < 0.8e0 THEN 10 ELSE 0 END) AS points, "
    "concat_ws('|', CASE WHEN pro < 1 THEN 'PRO_FORMA_DSCR<1.0' WHEN pro < 1.25e0 THEN 'PRO_FORMA_DSCR<1.25' END, CASE WHEN cover < 1 THEN 'DSCR<1.0' WHEN cover < 1.25e0 THEN 'DSCR<1.25' END, CASE WHEN z < 1.81e0 THEN 'Z<1.81' WHEN z < 2.99e0 THEN 'Z<2.99' END, "
    "CASE ltv_status WHEN 'BREACH' THEN 'LTV_BREACH' WHEN 'MARGINAL' THEN 'LTV_MARGINAL' END, CASE WHEN de > 3 THEN 'DE>3.0' WHEN de > 2 THEN 'DE>2.0' END, CASE WHEN quick < 0.8e0 THEN 'QUICK<0.8' END) AS rules FROM m)"
)


def _route(points: str) -> str:
    return f"CASE WHEN {points} >= 70 THEN 'DECLINE_RECOMMENDED' WHEN loan_amount >= 10e9 THEN 'CREDIT_COMMITTEE' WHEN {points} >= 40 THEN 'STANDARD_AUDIT' ELSE 'FAST_TRACK_REVIEW' END"


_COV = [
    "CASE WHEN COALESCE(NULLIF(cover, 0e0), pro) < 1.5e0 THEN 'Keep DSCR at 1.20 or more, tested yearly on audited accounts' END",
    "CASE WHEN de > 1.5e0 THEN 'Keep D/E at ' || format('{:,.1f}', GREATEST(ROUND(de * 0.85e0, 1), 2e0)) || 'x or less; no new debt without consent' END",
    "CASE WHEN quick < 1 THEN 'Keep the quick ratio at 0.80 or more, tested quarterly; 13-week cash flow on request' END",
    "CASE WHEN authority <> 'FAST_TRACK_REVIEW' THEN 'Route 70% of revenue or more through the lending bank' END",
    "CASE WHEN authority <> 'FAST_TRACK_REVIEW' THEN 'Deliver management accounts within 30 days of each quarter''s end' END",
]
_RATIOS = {
    "current_ratio": ("current_assets", "current_liabilities"), "cash_ratio": ("cash_and_equivalents", "current_liabilities"), "debt_to_assets": ("total_debt", "total_assets"), "liabilities_to_assets": ("total_liabilities", "total_assets"),
    "net_debt_to_ebitda": ("total_debt - cash_and_equivalents", "ebitda"), "gross_margin": ("gross_profit", "revenue"), "ebit_margin": ("ebit", "revenue"), "ebitda_margin": ("ebitda", "revenue"), "net_margin": ("net_income", "revenue"),
    "return_on_assets": ("net_income", "total_assets"), "return_on_equity": ("net_income", "total_equity"), "days_sales": ("accounts_receivable * 365e0", "revenue"), "days_inventory": ("inventory * 365e0", "cost_of_sales"),
    "days_payable": ("accounts_payable * 365e0", "cost_of_sales"), "asset_turnover": ("revenue", "total_assets"), "interest_coverage": ("ebit", "interest_expense"), "collateral_coverage": ("collateral_value", "loan_amount"),
    "haircut_coverage": ("collateral_value * (1e0 - haircut)", "loan_amount"),
}

ORACLES = {
    "f1_altman_z": f"WITH {_BASE}, v AS (SELECT *, CASE WHEN total_assets > 0 THEN {_Z} END AS v FROM companies) SELECT company, ROUND(v, 4) AS value, CASE WHEN v > 2.99e0 THEN 'SAFE' WHEN v >= 1.81e0 THEN 'GREY' WHEN v IS NOT NULL THEN 'DISTRESS' END AS verdict, CASE WHEN v IS NULL THEN 'total assets must be positive' END AS error, CASE WHEN total_assets > 0 THEN ROUND(working_capital / total_assets, 4) END AS x1, CASE WHEN total_liabilities > 0 THEN ROUND(market_cap / total_liabilities, 4) ELSE 0e0 END AS x4 FROM v",
    "f2_dscr": f"WITH {_BASE}, v AS (SELECT *, CASE WHEN annual_debt_service > 0 THEN net_operating_income / annual_debt_service END AS v FROM companies) SELECT company, ROUND(v, 4) AS value, {_BANDS} AS verdict, CASE WHEN v IS NULL THEN 'debt service must be positive' END AS error FROM v",
    "f3_pro_forma_dscr": f"WITH {_BASE}, g AS (SELECT *, {_GUARD3} AS error FROM companies), p AS (SELECT *, CASE WHEN error IS NULL THEN 12e0 * ({_PAY}) END AS pay FROM g), v AS (SELECT *, cfo / (annual_debt_service + pay) AS v FROM p) SELECT company, ROUND(v, 4) AS value, CASE WHEN cfo <= 0 THEN 'REJECT' ELSE {_BANDS} END AS verdict, error, ROUND(pay, 2) AS annual_payment FROM v",
    "f4_debt_to_equity": f"WITH {_BASE}, v AS (SELECT *, CASE WHEN total_equity > 0 THEN total_debt / total_equity END AS v FROM companies) SELECT company, ROUND(v, 4) AS value, CASE WHEN v <= 1 THEN 'LOW' WHEN v <= 2 THEN 'MEDIUM' WHEN v <= 3 THEN 'HIGH' ELSE 'CRITICAL' END AS verdict FROM v",
    "f5_quick_ratio": f"WITH {_BASE}, v AS (SELECT *, CASE WHEN current_liabilities > 0 THEN (cash_and_equivalents + short_term_investments + accounts_receivable) / current_liabilities END AS v FROM companies) SELECT company, ROUND(v, 4) AS value, CASE WHEN v >= 1 THEN 'ADEQUATE' WHEN v >= 0.8e0 THEN 'MARGINAL' WHEN v IS NOT NULL THEN 'WEAK' END AS verdict, CASE WHEN v IS NULL THEN 'current liabilities must be positive' END AS error FROM v",
    "f6_ltv": f"WITH {_BASE}, v AS (SELECT *, {_CEIL} AS c, CASE WHEN loan_amount > 0 AND collateral_value > 0 THEN loan_amount / collateral_value END AS v FROM companies) SELECT company, ROUND(v, 4) AS value, CASE WHEN v IS NULL THEN 'ERROR' WHEN v <= c THEN 'SAFE' WHEN v <= c * 1.15e0 THEN 'MARGINAL' ELSE 'BREACH' END AS verdict, CASE WHEN v IS NULL THEN 'amount and collateral must be positive' END AS error, CASE WHEN v IS NOT NULL THEN ROUND(collateral_value * c, 2) END AS max_safe_loan FROM v",
    "f7_f12_ratios": f"WITH {_BASE} SELECT company, " + ", ".join(f"CASE WHEN {b} > 0 THEN ROUND(({a}) / ({b}), 4) END AS {k}" for k, (a, b) in _RATIOS.items()) + ", ROUND(current_assets - current_liabilities, 2) AS net_working_capital, CASE WHEN revenue > 0 AND cost_of_sales > 0 THEN ROUND(accounts_receivable * 365e0 / revenue + inventory * 365e0 / cost_of_sales - accounts_payable * 365e0 / cost_of_sales, 4) END AS cash_cycle, ROUND(cfo / 1.25e0, 2) AS debt_capacity, ROUND(cfo - annual_debt_service, 2) AS debt_surplus FROM companies",
    "f13_rule_score": f"WITH {_METRICS} SELECT company, points AS score, rules FROM scored",
    "f19_assess": f"WITH {_METRICS}, fin AS (SELECT *, ROUND(LEAST(points + LEAST(CAST(company % 30 AS DOUBLE), 20e0), 100e0), 2) AS final_points FROM scored), routed AS (SELECT *, {_route('final_points')} AS authority FROM fin) SELECT company, points AS rule_points, final_points, CASE WHEN final_points >= 70 THEN 'CRITICAL' WHEN final_points >= 40 THEN 'HIGH' WHEN final_points >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level, authority, authority <> 'FAST_TRACK_REVIEW' AS human_review, concat_ws('|', {', '.join(_COV)}) AS covenants FROM routed",
    "f18_merge_covenants": f"WITH {_METRICS}, routed AS (SELECT *, {_route('points')} AS authority FROM scored), listed AS (SELECT company, list_filter([{', '.join(_COV)}], lambda x: x IS NOT NULL) AS own FROM routed) SELECT company, CASE WHEN company % 3 = 0 THEN array_to_string((['route 70% of revenue or more through our accounts', 'Pledge of shares'] || list_filter(own, lambda x: NOT contains('route 70% of revenue or more through our accounts', lower(x[1:30]))))[1:4], '|') ELSE array_to_string(own[1:4], '|') END AS covenants FROM listed",
    "f20_map_concepts": f"WITH {_FACTS} SELECT concept, COUNT(*) AS n, CAST(SUM(page) AS BIGINT) AS pages FROM facts GROUP BY 1",
    "f21_facts_to_wide": f"WITH {_FACTS}, best AS (SELECT *, row_number() OVER (PARTITION BY company, period, concept ORDER BY confidence DESC, fact_id) AS k FROM facts) SELECT company, period, ROUND(MAX(CASE WHEN concept = 'REVENUE' AND k = 1 THEN value END), 4) AS revenue, ROUND(MAX(CASE WHEN concept = 'DEBT' AND k = 1 THEN value END), 4) AS debt, ROUND(MAX(CASE WHEN concept = 'EBIT' AND k = 1 THEN value END), 4) AS ebit FROM best GROUP BY 1, 2",
    "f22_provenance": f"WITH {_FACTS} SELECT company, period, metric, string_agg(concept || ':' || fact_id || ':' || page, '|' ORDER BY concept, fact_id) AS inputs FROM facts JOIN (VALUES ('debt_to_revenue', 'DEBT'), ('debt_to_revenue', 'REVENUE'), ('margin', 'EBIT'), ('margin', 'REVENUE')) i(metric, concept) USING (concept) GROUP BY 1, 2, 3",
    "f23_data_gaps": f"WITH {_FACTS} SELECT s.company, s.period, r.concept FROM (SELECT DISTINCT company, period FROM facts) s, (VALUES ('REVENUE'), ('EBIT'), ('CFO')) r(concept) WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.company = s.company AND f.period = s.period AND f.concept = r.concept)",
    "f24_period_compare": f"WITH {_FACTS}, p AS (SELECT company, period, value, lag(value) OVER (PARTITION BY company ORDER BY period) AS prior FROM facts WHERE label = 'Total Debt') SELECT company, period, ROUND(prior, 2) AS prior, ROUND(value - prior, 2) AS change, CASE WHEN prior <> 0 THEN ROUND((value - prior) / abs(prior), 4) END AS change_share FROM p",
    "f25_cross_source_check": f"WITH {_FACTS}, base AS (SELECT * FROM facts WHERE label IN ('Total Debt', 'EBIT')), a AS (SELECT * FROM base WHERE fact_id % 13 <> 0), b AS (SELECT company, concept, period, value * (1e0 + (company % 7) * 0.02e0) AS value FROM base WHERE fact_id % 11 <> 0) SELECT * FROM (SELECT COALESCE(a.company, b.company) AS company, COALESCE(a.concept, b.concept) AS concept, COALESCE(a.period, b.period) AS period, CASE WHEN a.value IS NULL THEN 'MISSING_A' WHEN b.value IS NULL THEN 'MISSING_B' WHEN CASE WHEN a.value <> 0 THEN abs(a.value - b.value) / abs(a.value) ELSE abs(b.value) END > 0.05e0 THEN 'MISMATCH' END AS signal FROM a FULL JOIN b ON a.company = b.company AND a.concept = b.concept AND a.period = b.period) WHERE signal IS NOT NULL",
    "f26_convert_currency": f"WITH {_BASE}, x AS (SELECT company, floor(revenue) AS revenue, CASE company % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 25000e0 ELSE 0.9e0 END AS a, CASE company % 4 WHEN 0 THEN 0.9e0 WHEN 1 THEN NULL ELSE 1e0 END AS b FROM companies) SELECT company, ROUND(revenue / a * b, 2) AS amount, CASE WHEN b IS NULL THEN 'unknown currency' END AS error FROM x",
    "g9_related_parties": "WITH e AS (SELECT c_custkey AS a, c_custkey * 7 % 1000 + 1 AS b FROM customer), pairs AS (SELECT a AS src, b AS dst FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b) SELECT src, COUNT(*) AS n_related, ROUND(SUM(c_acctbal), 2) AS exposure FROM pairs JOIN customer ON c_custkey = dst GROUP BY 1",
}
