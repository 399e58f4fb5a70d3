"""Vector arithmetic as column expressions over arrays; sums are in double."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l1_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: F.abs(x.cast("double"))))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for all the places that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """Null for a zero vector."""
    return let(F.struct(v.alias("v"), l2_norm(v).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])))


def hashed_vector(tokens: Column, width: int = 64) -> Column:
    """Counts of tokens by hash, of unit norm. Null for no tokens."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    counts = let(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))
    return l2_normalize(counts)
