"""Filters and validation of rows."""

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import RISK_TERMS, contained_terms


def matching(rows: DataFrame, must: Mapping[str, Any] | None = None, ranges: Mapping[str, tuple[Any, Any]] | None = None) -> DataFrame:
    """Rows equal in all of `must` and within all `ranges`, ends included; None leaves an end open."""
    for k, v in (must or {}).items():
        rows = rows.where(F.col(k) == F.lit(v))
    for k, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            rows = rows.where(F.col(k) >= F.lit(lo))
        if hi is not None:
            rows = rows.where(F.col(k) <= F.lit(hi))
    return rows


def prefix_filter(rows: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows with one of the codes; a trailing * makes a code a prefix. No codes: all rows."""
    if not codes:
        return rows
    exact, begin = [c for c in codes if not c.endswith("*")], [c[:-1] for c in codes if c.endswith("*")]
    test = F.col(column).isin(exact)
    for p in begin:
        test = test | F.col(column).startswith(p)
    return rows.where(test)


def score_threshold(rows: DataFrame, least: float, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= least)


def approved_only(rows: DataFrame, department: str, key: str = "record_id", version: str = "version") -> DataFrame:
    """The department's approved rows, each record's latest version only."""
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version))) == 1
    return rows.where((F.col("department") == department) & F.col("approved")).withColumn("_latest", latest).where("_latest").drop("_latest")


def validate_rows(rows: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with `broken`, the names of those they break). Rules are SQL predicates; null breaks one."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(k)) for k, r in rules.items())))
    marked = rows.withColumn("broken", broken)
    return marked.where("size(broken) = 0").drop("broken"), marked.where("size(broken) > 0")


def parse_rows(rows: DataFrame, text: str, schema: str, required: Sequence[str] = (), rules: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON texts as typed rows: (the rows with the schema's columns in place of the text, the others as they are with `broken`).

    A text that isn't JSON, or has a value of another type, breaks `json`; a required field that is null breaks its name; rules are SQL predicates
    on the fields, as in validate_rows, and judge only texts that could be read. Each text is read once; fields that the schema lacks go.
    """
    parsed = F.from_json(text, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("_parsed", parsed)
    unread = F.col("_parsed").isNull() | F.col("_parsed._corrupt_record").isNotNull()
    names = [f.name for f in rows.schema["_parsed"].dataType.fields if f.name != "_corrupt_record"]
    keep = [c for c in rows.columns if c not in (text, "_parsed")]
    fields = rows.select("*", *(F.col(f"_parsed.{c}").alias(c) for c in names if c not in rows.columns), unread.alias("_unread"))
    held = {c: F.col(f"_parsed.{c}") for c in names}
    found = [F.when(F.col("_unread"), F.lit("json")), *(F.when(~F.col("_unread") & held[c].isNull(), F.lit(c)) for c in required)]
    found += [F.when(~F.col("_unread") & ~F.coalesce(F.expr(r), F.lit(False)), F.lit(k)) for k, r in (rules or {}).items()]
    marked = fields.withColumn("broken", F.array_compact(F.array(*found)))
    return marked.where("size(broken) = 0").select(*keep, *(held[c].alias(c) for c in names)), marked.where("size(broken) > 0").select(*(c for c in rows.columns if c != "_parsed"), "broken")


def keyword_scan(snippets: DataFrame, terms: Sequence[str] = tuple(RISK_TERMS)) -> DataFrame:
    """company, hits (in the terms' order), flags, the first three snippets, from rows of company, pos, snippet."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: x["snippet"])
    rows = snippets.groupBy("company").agg(own.alias("s"))
    hits = contained_terms(F.array_join("s", " "), terms)
    return rows.select("company", hits.alias("hits"), F.transform(hits, lambda x: F.concat(F.lit("[Web] "), F.upper(x))).alias("flags"), F.slice("s", 1, 3).alias("snippets"))


def optional_filters(rows: DataFrame, at_least: Mapping[str, Any] | None = None, containing: Mapping[str, str | None] | None = None) -> DataFrame:
    """Each filter counts only if given: a least value, a part of a text regardless of case."""
    for k, v in (at_least or {}).items():
        rows = rows if v is None else rows.where(F.col(k) >= F.lit(v))
    for k, v in (containing or {}).items():
        rows = rows if v is None else rows.where(F.contains(F.lower(k), F.lit(v.lower())))
    return rows
