"""Groups of which one may hold a large share of all rows."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salts(n_rows: int) -> int:
    """Into how many parts a group's rows are dealt: a group of all rows has as many parts as a part has rows."""
    return max(16, math.isqrt(n_rows))


def salt(n_rows: int, *by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(salts(n_rows))).cast("int")


def later_in_group(rows: DataFrame, group: str, value: str, n_rows: int) -> DataFrame:
    """The distinct (value, group) with a value that isn't the least of its group. Only parts of groups meet in a task: least values of parts first, then of groups, then back."""
    rows = rows.select(value, group).withColumn("salt", salt(n_rows, value))
    parts = rows.groupBy(group, "salt").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    least = parts.groupBy(group).agg(F.min("low").alias("least"), F.max("high").alias("high")).where("least < high").select(group, "least")
    parts = parts.join(least, group).where("high > least").select(group, "salt", "least")
    return rows.join(parts, [group, "salt"]).where(F.col(value) > F.col("least")).select(value, group).distinct()
