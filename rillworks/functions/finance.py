"""Credit ratios and verdicts as column expressions. A guard gives a null value and an error text, never an exception."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands, ceilings, points.
Z_SAFE, Z_GREY = 2.99, 1.81
COVERED, COVERED_BARELY = 1.25, 1.0
DEBT_BANDS = [(1.0, "LOW"), (2.0, "MEDIUM"), (3.0, "HIGH")]
QUICK_ENOUGH, QUICK_BARELY = 1.0, 0.8
CEILINGS = {"real_estate": 0.70, "machinery": 0.50, "securities": 0.60, "other": 0.40}
MARGIN = 1.15
DECLINE, AUDIT, WATCH, COMMITTEE = 70.0, 40.0, 20.0, 10e9
RATES = {"USD": 1.0, "VND": 25000.0, "EUR": 0.9}
DAYS = 365.0

_c = F.col


def _d(name: str) -> Column:
    return _c(name).cast("double")


def rounded(x: Column, places: int) -> Column:
    """x to so many places, halves away from zero, as SQL engines round doubles: the scaled double decides what is a half, not x in decimal digits, so 0.85 * 9 (7.6499999999999995) to one place is 7.7."""
    scale = float(10**places)
    return F.round(x * scale, 0) / scale


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null where bottom isn't positive."""
    return F.when(bottom > 0, top / bottom)


def _guarded(bad: Column, message: str, value: Column, verdict: Column, otherwise: str | None = None) -> Column:
    """value to four places, verdict from the value before rounding, error."""
    return F.struct(
        F.when(~bad, rounded(value, 4)).alias("value"), F.when(bad, F.lit(otherwise)).otherwise(verdict).alias("verdict"), F.when(bad, F.lit(message)).alias("error")
    )


def altman_z(wc="working_capital", ta="total_assets", re="retained_earnings", ebit="ebit", mc="market_cap", tl="total_liabilities", revenue="revenue") -> Column:
    """value, verdict, error and the five terms x1 to x5."""
    a = _d(ta)
    x = [ratio(_d(wc), a), ratio(_d(re), a), ratio(_d(ebit), a), F.coalesce(ratio(_d(mc), _d(tl)), F.lit(0.0)), ratio(_d(revenue), a)]
    z = sum((F.lit(w) * t for w, t in zip((1.2, 1.4, 3.3, 0.6, 1.0), x)), F.lit(0.0))
    band = F.when(z > Z_SAFE, "SAFE").when(z >= Z_GREY, "GREY").when(z.isNotNull(), "DISTRESS")
    return _guarded(~F.coalesce(a > 0, F.lit(False)), "total assets must be positive", z, band).withField("terms", F.struct(*(rounded(t, 4).alias(f"x{i}") for i, t in enumerate(x, 1))))


def _coverage(v: Column) -> Column:
    return F.when(v >= COVERED, "ADEQUATE").when(v >= COVERED_BARELY, "MARGINAL").when(v.isNotNull(), "INSUFFICIENT")


def dscr(income="net_operating_income", service="annual_debt_service") -> Column:
    v = ratio(_d(income), _d(service))
    return _guarded(~F.coalesce(_d(service) > 0, F.lit(False)), "debt service must be positive", v, _coverage(v))


def pro_forma_dscr(cfo="cfo", existing="annual_debt_service", amount="loan_amount", months="loan_term_months", rate="interest_rate") -> Column:
    """Coverage with the new loan's payments. The guards stand in this order: cash flow, term, rate, amount."""
    r = _d(rate) / 1200
    growth = F.pow(1 + r, _d(months))
    payment = _d(amount) * r * growth / F.nullif(growth - 1, F.lit(0.0))
    service = _d(existing) + 12 * payment
    v = ratio(_d(cfo), service)
    error = F.when(~F.coalesce(_d(cfo) > 0, F.lit(False)), "cash flow must be positive").when(~F.coalesce(_d(months) > 0, F.lit(False)), "term must be positive")
    error = error.when(~F.coalesce(_d(rate) > 0, F.lit(False)), "rate must be positive").when(~F.coalesce(_d(amount) > 0, F.lit(False)), "amount must be positive")
    ok = error.isNull()
    verdict = F.when(~F.coalesce(_d(cfo) > 0, F.lit(False)), "REJECT").when(ok, _coverage(v))
    return F.struct(F.when(ok, rounded(v, 4)).alias("value"), verdict.alias("verdict"), error.alias("error"), F.when(ok, rounded(12 * payment, 2)).alias("annual_payment"), F.when(ok, rounded(service, 2)).alias("total_service"))


def debt_to_equity(debt="total_debt", equity="total_equity") -> Column:
    """Equity that isn't positive is critical, not an error."""
    v = ratio(_d(debt), _d(equity))
    band = F.lit(None).cast("string")
    for most, name in reversed(DEBT_BANDS):
        band = F.when(v <= most, name).otherwise(F.lit("CRITICAL") if name == "HIGH" else band)
    return F.struct(rounded(v, 4).alias("value"), F.when(v.isNull(), "CRITICAL").otherwise(band).alias("verdict"), F.lit(None).cast("string").alias("error"))


def quick_ratio(cash="cash_and_equivalents", invested="short_term_investments", receivable="accounts_receivable", owed="current_liabilities") -> Column:
    v = ratio(_d(cash) + _d(invested) + _d(receivable), _d(owed))
    band = F.when(v >= QUICK_ENOUGH, "ADEQUATE").when(v >= QUICK_BARELY, "MARGINAL").when(v.isNotNull(), "WEAK")
    return _guarded(~F.coalesce(_d(owed) > 0, F.lit(False)), "current liabilities must be positive", v, band)


def ltv(amount="loan_amount", value="collateral_value", kind="collateral_type") -> Column:
    """Loan to value against the ceiling of the collateral's type; an unknown type is `other`."""
    name = F.lower(F.trim(_c(kind)))
    known = F.create_map(*(F.lit(x) for kv in CEILINGS.items() for x in kv))
    ceiling = F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit("other"))), F.lit(CEILINGS["other"]))
    v = ratio(_d(amount), _d(value))
    bad = ~F.coalesce((_d(amount) > 0) & (_d(value) > 0), F.lit(False))
    verdict = F.when(bad, "ERROR").when(v <= ceiling, "SAFE").when(v <= ceiling * MARGIN, "MARGINAL").otherwise("BREACH")
    return F.struct(F.when(~bad, rounded(v, 4)).alias("value"), verdict.alias("verdict"), F.when(bad, "amount and collateral must be positive").alias("error"), F.when(~bad, rounded(_d(value) * ceiling, 2)).alias("max_safe_loan"))


def _simple(top: Callable[[], Column], bottom: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: rounded(ratio(top(), bottom()), 4)


#: Name to a column of the ratio, to four places; null where the denominator isn't positive.
FORMULAS: dict[str, Callable[..., Column]] = {
    "altman_z": altman_z, "dscr": dscr, "pro_forma_dscr": pro_forma_dscr, "debt_to_equity": debt_to_equity, "quick_ratio": quick_ratio, "ltv": ltv,
    "current_ratio": _simple(lambda: _d("current_assets"), lambda: _d("current_liabilities")),
    "cash_ratio": _simple(lambda: _d("cash_and_equivalents"), lambda: _d("current_liabilities")),
    "net_working_capital": lambda: rounded(_d("current_assets") - _d("current_liabilities"), 2),
    "debt_to_assets": _simple(lambda: _d("total_debt"), lambda: _d("total_assets")),
    "liabilities_to_assets": _simple(lambda: _d("total_liabilities"), lambda: _d("total_assets")),
    "net_debt_to_ebitda": _simple(lambda: _d("total_debt") - _d("cash_and_equivalents"), lambda: _d("ebitda")),
    "gross_margin": _simple(lambda: _d("gross_profit"), lambda: _d("revenue")),
    "ebit_margin": _simple(lambda: _d("ebit"), lambda: _d("revenue")),
    "ebitda_margin": _simple(lambda: _d("ebitda"), lambda: _d("revenue")),
    "net_margin": _simple(lambda: _d("net_income"), lambda: _d("revenue")),
    "return_on_assets": _simple(lambda: _d("net_income"), lambda: _d("total_assets")),
    "return_on_equity": _simple(lambda: _d("net_income"), lambda: _d("total_equity")),
    "days_sales": _simple(lambda: _d("accounts_receivable") * DAYS, lambda: _d("revenue")),
    "days_inventory": _simple(lambda: _d("inventory") * DAYS, lambda: _d("cost_of_sales")),
    "days_payable": _simple(lambda: _d("accounts_payable") * DAYS, lambda: _d("cost_of_sales")),
    "cash_cycle": lambda: rounded(ratio(_d("accounts_receivable") * DAYS, _d("revenue")) + ratio(_d("inventory") * DAYS, _d("cost_of_sales")) - ratio(_d("accounts_payable") * DAYS, _d("cost_of_sales")), 4),
    "asset_turnover": _simple(lambda: _d("revenue"), lambda: _d("total_assets")),
    "interest_coverage": _simple(lambda: _d("ebit"), lambda: _d("interest_expense")),
    "debt_capacity": lambda: rounded(_d("cfo") / COVERED, 2),
    "debt_surplus": lambda: rounded(_d("cfo") - _d("annual_debt_service"), 2),
    "collateral_coverage": _simple(lambda: _d("collateral_value"), lambda: _d("loan_amount")),
    "haircut_coverage": _simple(lambda: _d("collateral_value") * (1 - _d("haircut")), lambda: _d("loan_amount")),
}


def _points(cases: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Of the first case that holds: points and name; no points for null."""
    points, name = F.lit(0), F.lit(None).cast("string")
    for test, n, text in reversed(cases):
        points, name = F.when(test, n).otherwise(points), F.when(test, text).otherwise(name)
    return points, name


def rule_score(z="altman_z_score", cover="dscr", pro="pro_forma_dscr", debt="debt_to_equity", quick="quick_ratio", status="ltv_status") -> Column:
    """score (0 to 100) and the rules that gave points, in this order. A null metric gives none."""
    z, cover, pro, debt, quick, status = map(_c, (z, cover, pro, debt, quick, status))
    rules = [
        [(pro < 1.0, 45, "PRO_FORMA_DSCR<1.0"), (pro < 1.25, 20, "PRO_FORMA_DSCR<1.25")], [(cover < 1.0, 40, "DSCR<1.0"), (cover < 1.25, 15, "DSCR<1.25")],
        [(z < Z_GREY, 30, "Z<1.81"), (z < Z_SAFE, 10, "Z<2.99")], [(status == "BREACH", 25, "LTV_BREACH"), (status == "MARGINAL", 10, "LTV_MARGINAL")],
        [(debt > 3.0, 20, "DE>3.0"), (debt > 2.0, 8, "DE>2.0")], [(quick < 0.8, 10, "QUICK<0.8")],
    ]
    points = [_points(r) for r in rules]
    return F.struct(F.least(F.lit(100.0), sum((p for p, _ in points), F.lit(0)).cast("double")).alias("score"), F.array_compact(F.array(*(n for _, n in points))).alias("rules"))


def final_score(rule: Column, qualitative: Column) -> Column:
    """Qualitative points count up to 20, the sum up to 100."""
    return rounded(F.least(rule + F.least(F.coalesce(qualitative, F.lit(0.0)), F.lit(20.0)), F.lit(100.0)), 2)


def route_authority(score: Column, loan: Column) -> Column:
    name = F.when(score >= DECLINE, "DECLINE_RECOMMENDED").when(loan >= COMMITTEE, "CREDIT_COMMITTEE").when(score >= AUDIT, "STANDARD_AUDIT").otherwise("FAST_TRACK_REVIEW")
    reason = F.when(score >= DECLINE, "score").when(loan >= COMMITTEE, "amount").when(score >= AUDIT, "score").otherwise("none")
    return F.struct(name.alias("authority"), (name != "FAST_TRACK_REVIEW").alias("human_review"), reason.alias("reason"))


def risk_level(score: Column) -> Column:
    return F.when(score >= DECLINE, "CRITICAL").when(score >= AUDIT, "HIGH").when(score >= WATCH, "MEDIUM").when(score.isNotNull(), "LOW")


def covenants(cover: Column, pro: Column, debt: Column, quick: Column, authority: Column) -> Column:
    """A coverage of 0 counts as missing here, and the pro-forma one stands in."""
    used = F.coalesce(F.nullif(cover, F.lit(0.0)), pro)
    limit = F.greatest(rounded(debt * 0.85, 1), F.lit(2.0))
    more = F.coalesce(authority.isin("STANDARD_AUDIT", "CREDIT_COMMITTEE", "DECLINE_RECOMMENDED"), F.lit(False))
    return F.array_compact(F.array(
        F.when(used < 1.5, "Keep DSCR at 1.20 or more, tested yearly on audited accounts"),
        F.when(debt > 1.5, F.concat(F.lit("Keep D/E at "), F.format_number(limit, 1), F.lit("x or less; no new debt without consent"))),
        F.when(quick < 1.0, "Keep the quick ratio at 0.80 or more, tested quarterly; 13-week cash flow on request"),
        F.when(more, "Route 70% of revenue or more through the lending bank"),
        F.when(more, "Deliver management accounts within 30 days of each quarter's end")))


def merge_covenants(given: Column, default: Column, most: int = 6) -> Column:
    """The given ones first; a default joins unless its first 30 characters occur in one accepted before, regardless of case."""
    start = F.coalesce(given, F.array().cast("array<string>"))
    merged = F.aggregate(default, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.contains(F.lower(y), F.lower(F.substring(x, 1, 30)))), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(merged, 1, most)


def convert_currency(amount: Column, source: Column, target: Column) -> Column:
    """By way of the dollar, to two places; an unknown code is an error."""
    rate = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))
    a, b = (F.try_element_at(rate, F.coalesce(x, F.lit(""))) for x in (source, target))
    return F.struct(rounded(amount / a * b, 2).alias("amount"), F.when(a.isNull() | b.isNull(), "unknown currency").alias("error"))
