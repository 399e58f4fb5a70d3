"""Credit assessment of companies, and facts about them in long form."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance as f
from .search import small


def metrics(rows: DataFrame) -> DataFrame:
    """The six ratios and the collateral's status beside each row's own columns: one projection, no shuffle."""
    rows = rows.withColumns({"_z": f.altman_z(), "_d": f.dscr(), "_p": f.pro_forma_dscr(), "_e": f.debt_to_equity(), "_q": f.quick_ratio(), "_l": f.ltv()})
    names = {"altman_z_score": "_z", "dscr": "_d", "pro_forma_dscr": "_p", "debt_to_equity": "_e", "quick_ratio": "_q"}
    return rows.withColumns({k: F.col(f"{v}.value") for k, v in names.items()} | {"ltv_status": F.col("_l.verdict")}).drop("_z", "_d", "_p", "_e", "_q", "_l")


def assess(rows: DataFrame, qualitative: str | Column | None = None) -> DataFrame:
    """Ratios, rule score, final score, level, authority and covenants of each row. All metrics go into the score, the pro-forma and collateral ones too."""
    extra = F.lit(0.0) if qualitative is None else F.col(qualitative) if isinstance(qualitative, str) else qualitative
    rows = metrics(rows).withColumn("_rule", f.rule_score())
    rows = rows.withColumns({"rule_points": F.col("_rule.score"), "rules": F.col("_rule.rules"), "final_points": f.final_score(F.col("_rule.score"), extra)})
    rows = rows.withColumn("_route", f.route_authority(F.col("final_points"), F.col("loan_amount")))
    rows = rows.withColumns({"authority": F.col("_route.authority"), "human_review": F.col("_route.human_review"), "level": f.risk_level(F.col("final_points"))})
    own = f.covenants(F.col("dscr"), F.col("pro_forma_dscr"), F.col("debt_to_equity"), F.col("quick_ratio"), F.col("authority"))
    return rows.withColumn("covenants", F.slice(own, 1, 6)).drop("_rule", "_route")


def map_concepts(facts: DataFrame, ontology: DataFrame, label: str = "label") -> DataFrame:
    """concept of each fact by its label, regardless of case and outer space; null where the ontology (alias, concept) has none."""
    names = small(ontology.select(F.lower(F.trim("alias")).alias("_alias"), "concept").dropDuplicates(["_alias"]))
    return facts.join(names, F.lower(F.trim(F.col(label))) == F.col("_alias"), "left").drop("_alias")


def facts_to_wide(facts: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """One row for each company and period: of each concept the value of highest confidence, then least fact_id."""
    best = facts.groupBy("company", "period").agg(*(F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.struct("confidence", -F.col("fact_id")))).alias(c) for c in concepts))
    return best


def provenance(inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """For each company, period and metric of inputs (metric, concept): the facts that it was computed from, ordered by concept."""
    joined = facts.join(small(inputs), "concept")
    items = F.array_sort(F.collect_list(F.struct("concept", "fact_id", "page", "value")))
    return joined.groupBy("company", "period", "metric").agg(items.alias("inputs"))


def data_gaps(required: DataFrame, facts: DataFrame) -> DataFrame:
    """Required concepts (a short list) that a company has no fact for in a period."""
    seen = facts.select("company", "period").distinct()
    return seen.join(small(required.select("concept")), F.lit(True)).join(facts.where("value IS NOT NULL").select("company", "period", "concept"), ["company", "period", "concept"], "left_anti")


def period_compare(facts: DataFrame) -> DataFrame:
    """Each fact with the value of the company's and concept's prior period, the change and the share of it."""
    w = W.partitionBy("company", "concept").orderBy("period")
    prior = F.lag("value").over(w)
    return facts.withColumn("prior", prior).withColumn("change", F.col("value") - F.col("prior")).withColumn("change_share", F.when(F.col("prior") != 0, F.round((F.col("value") - F.col("prior")) / F.abs("prior"), 4)))


def cross_source_check(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Facts that two sources give differently by more than the tolerance, relative to the first, or that one lacks."""
    keys = ["company", "concept", "period"]
    both = a.select(*keys, F.col("value").alias("value_a")).join(b.select(*keys, F.col("value").alias("value_b")), keys, "full_outer")
    gap = F.when(F.col("value_a") != 0, F.abs(F.col("value_a") - F.col("value_b")) / F.abs("value_a")).otherwise(F.abs("value_b"))
    signal = F.when(F.col("value_a").isNull(), "MISSING_A").when(F.col("value_b").isNull(), "MISSING_B").when(gap > tolerance, "MISMATCH")
    return both.withColumn("signal", signal).where("signal IS NOT NULL")


def related_parties(edges: DataFrame, exposure: DataFrame) -> DataFrame:
    """For each company: its related parties and the sum of what they owe. edges (src, dst), exposure (id, amount)."""
    joined = edges.select("src", "dst").distinct().join(exposure.select(F.col("id").alias("dst"), "amount"), "dst")
    return joined.groupBy("src").agg(F.count("*").alias("n_related"), F.round(F.sum("amount"), 2).alias("exposure"))
