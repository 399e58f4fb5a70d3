"""Sums and quantiles over ranges of an order, and quantile sketches that add up."""

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut


def same(by: Sequence[str], left: str = "", right: str = "_") -> Column:
    """Equal groups; a null is a group as any other."""
    return reduce(Column.__and__, (F.col(f"{c}{left}").eqNullSafe(F.col(f"{c}{right}")) for c in by), F.lit(True))


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """The rows with each sum over the group's rows up to it in the order.

    Rows are dealt out by ranges of the order and written, so that ranges stay as they are; sums run over the ranges' totals first, then inside
    each range. A group may hold all rows; a null is a group as any other."""
    rows = cut(rows.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*by, "range_").agg(*(F.sum(c).alias(f"{k}_") for k, c in sums.items()))
    above = W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"{c}_") for c in by), F.col("range_").alias("range__"), *(F.coalesce(F.sum(f"{k}_").over(above), F.lit(0)).alias(f"{k}_") for k in sums))
    inside = W.partitionBy(*by, "range_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(totals, same(by) & (F.col("range_") == F.col("range__"))).select(*(c for c in rows.columns if c != "range_"), *((F.col(f"{k}_") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()))


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """by, quantiles: for each probability the value at that share of the group's order, between two values in proportion. Nulls don't count; a group of nulls only has no row.

    Counts of distinct values are dealt by ranges and summed range by range, so no task orders a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value_")).agg(F.count("*").alias("n_"))
    ends = running_sums(counts, by, ["value_"], upto_=F.col("n_"))
    totals = counts.groupBy(*by).agg(F.sum("n_").alias("total_")).select(*(F.col(c).alias(f"{c}_") for c in by), "total_")
    ends = ends.join(totals, same(by)) if by else ends.withColumn("total_", F.lit(totals.first()[0] or 0))
    at = [(F.col("total_") - 1) * F.lit(float(p)) for p in probs]
    holds = lambda rank: F.max(F.when((F.col("upto_") > rank) & (F.col("upto_") - F.col("n_") <= rank), F.col("value_")))
    low, high = ([holds(f(x)) for x in at] for f in (F.floor, F.ceil))
    out = ends.groupBy(*by).agg(F.max("total_").alias("total_"), F.array(*low).alias("low_"), F.array(*high).alias("high_"))
    share = lambda i, p: (F.col("total_") - 1) * F.lit(float(p)) - F.floor((F.col("total_") - 1) * F.lit(float(p)))
    return out.select(*by, F.array(*((1 - share(i, p)) * F.col("low_")[i] + share(i, p) * F.col("high_")[i] for i, p in enumerate(probs))).alias("quantiles"))


#: Buckets of positive numbers begin here, those of negative ones below its negative.
_OFFSET = 1 << 20


def bucket(value: Column, alpha: float = 0.01) -> Column:
    """The number of a value's bucket: a bucket's numbers differ from its middle by a share of `alpha` at most. Buckets rise with their values; 0 and either infinity have their own; null for null and NaN."""
    x = value.cast("double")
    step = F.ceil(F.least(F.lit(float(_OFFSET - 1)), F.log(F.abs(x)) / math.log((1 + alpha) / (1 - alpha))))
    return F.when(x.isNull() | F.isnan(x), None).when(x == 0, F.lit(0)).when(x > 0, _OFFSET + step).otherwise(-_OFFSET - step).cast("long")


def bucket_value(number: Column, alpha: float = 0.01) -> Column:
    base = (1 + alpha) / (1 - alpha)
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * 2 / (base + 1) * F.pow(F.lit(base), F.abs(number) - _OFFSET))


def sketch(rows: DataFrame, by: Sequence[str], value: str, alpha: float = 0.01) -> DataFrame:
    """by, bucket, n: a group's values as counts of buckets, some thousands at most whatever the number of rows. Sketches of parts add up to that of the whole: they are unions, summed (`merged`)."""
    return rows.select(*by, bucket(F.col(value), alpha).alias("bucket")).where(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merged(sketches: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def at_rank(buckets: Column, total: Column, p: float, alpha: float = 0.01) -> Column:
    """The value of the first bucket of an ordered array of (bucket, n) up to which a share p of the total lies."""
    rank = F.greatest(F.lit(1), F.ceil(total * F.lit(float(p))))
    found = F.aggregate(buckets, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("b")), lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.coalesce(s["b"], F.when(s["sum"] + x["n"] >= rank, x["bucket"])).alias("b")))
    return bucket_value(found["b"], alpha)


def ordered_buckets(bucket: str = "bucket", n: str = "n") -> Column:
    """An aggregate: the group's buckets in order, null ones left out. Their number has a bound, not the group's."""
    return F.array_sort(F.collect_list(F.when(F.col(bucket).isNotNull(), F.struct(F.col(bucket).alias("bucket"), F.col(n).alias("n")))))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """by, n, quantiles of sketches (by, bucket, n): each differs from the value at rank ceil(p * n) of the group by a share of `alpha` at most."""
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), ordered_buckets().alias("b_"))
    return out.select(*by, "n", F.array(*(at_rank(F.col("b_"), F.col("n"), p, alpha) for p in probs)).alias("quantiles"))
