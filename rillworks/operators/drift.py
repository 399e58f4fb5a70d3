"""Drift of a value's distribution against a reference: bins from a sketch, and the population stability index of each span of time."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import sketch, sketch_quantiles

# The usual limits of a moderate and of a major shift.
MODERATE, MAJOR = 0.1, 0.25


def reference_edges(reference: DataFrame, value: str, bins: int = 10, alpha: float = 0.01) -> list[float]:
    """The inner edges of `bins` bins of about equal counts, by a sketch; fewer where values repeat. One row of at most bins - 1 numbers reaches the driver."""
    found = sketch_quantiles(sketch(reference, [], value, alpha), [], [i / bins for i in range(1, bins)], alpha).first()
    return sorted({float(x) for x in found.quantiles if x is not None and math.isfinite(x)}) if found and found.n else []


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0 below the first edge, one more from each edge on; the last number is that of null and NaN."""
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x), len(edges) + 1).otherwise(sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")


def bin_counts(value: Column, edges: Sequence[float]) -> Column:
    """An aggregate: an array of counts, one for each bin, the last that of missing values."""
    at = bin_of(value, edges)
    return F.array(*(F.sum(F.when(at == i, 1).otherwise(0)) for i in range(len(edges) + 2)))


def divergence(expected: Column, actual: Column, smoothing: float = 0.5) -> Column:
    """The population stability index of two arrays of counts, bin by bin, with `smoothing` added to each count so that empty bins have a share; 0 for equal shares."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x + smoothing)
    both = F.arrays_zip(expected.alias("e"), actual.alias("a"))
    shares = lambda x, e, a: ((x["e"] + smoothing) / e, (x["a"] + smoothing) / a)

    def part(s: Column, x: Column) -> Column:
        p, q = shares(x, total(expected), total(actual))
        return s + (q - p) * F.log(q / p)

    return F.aggregate(both, F.lit(0.0), part)


def value_drift(rows: DataFrame, reference: DataFrame, value: str, every: str = "1 hour", edges: Sequence[float] | None = None, bins: int = 10, by: Sequence[str] = (), ts: str = "ts", smoothing: float = 0.5) -> DataFrame:
    """by, start, n, psi, drift (none, moderate, major): each span of time and group against the whole reference, over given edges or those of the reference's sketch.

    One partial aggregate over the rows; the reference is two arrays' worth of numbers. Missing values are a bin of their own. Takes a streaming
    frame with a watermark too.
    """
    edges = reference_edges(reference, value, bins) if edges is None else sorted(edges)
    known = reference.agg(bin_counts(F.col(value), edges).alias("c")).first().c
    expected = F.array(*(F.lit(float(x or 0)) for x in known))
    out = rows.groupBy(*by, F.window(ts, every)).agg(F.count("*").alias("n"), bin_counts(F.col(value), edges).alias("counts"))
    psi = divergence(expected, F.transform("counts", lambda x: x.cast("double")), smoothing)
    return out.select(*by, F.col("window.start").alias("start"), "n", psi.alias("psi")).withColumn("drift", F.when(F.col("psi") >= MAJOR, "major").when(F.col("psi") >= MODERATE, "moderate").otherwise("none"))


def ks_statistic(rows: DataFrame, label: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """by, ks, gini: the widest gap between the scores' distributions of the two labels, and twice the area under the ROC curve less one; null where a label is missing."""
    from .detect import roc_auc
    from .quantiles import running_sums, same

    counts = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("m"))
    sums = running_sums(counts, by, [score], up=F.col("p"), um=F.col("m"))
    total = sums.groupBy(*by).agg(F.max("up").alias("tp"), F.max("um").alias("tm")).select(*(F.col(c).alias(f"{c}_") for c in by), "tp", "tm")
    gap = F.max(F.abs(F.col("up") / F.nullif("tp", F.lit(0)) - F.col("um") / F.nullif("tm", F.lit(0)))).alias("ks")
    found = sums.join(total, same(by)).groupBy(*by).agg(gap)
    auc = roc_auc(rows, label, score, by).select(*(F.col(c).alias(f"{c}_") for c in by), (2 * F.col("auc") - 1).alias("gini"))
    return found.join(auc, same(by)).select(*by, "ks", "gini")
