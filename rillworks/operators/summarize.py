"""Texts of many parts brought down to one by rounds of reduction."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, split_by_tokens
from .cut import cut
from .quantiles import running_sums

SEPARATOR = "\n\n---\n\n"


def leading_tokens(most: int) -> Callable[[list[str]], list[str]]:
    """A reduction that needs no model: the first sentence of each part, `most` words at the most."""

    def run(texts: list[str]) -> list[str]:
        firsts = (" ".join(p.split(". ")[0].rstrip(".") + "." for p in x.split(SEPARATOR)) for x in texts)
        return [" ".join(x.split()[:most]) for x in firsts]

    return run


def reduce_text(parts: DataFrame, group: str, number: str, text: str, reduce_fn: Callable[[list[str]], list[str]] | None = None, budget: int = 2000, rounds: int = 40) -> DataFrame:
    """group, text, rounds: each group's parts in order, joined and reduced by `reduce_fn` (lists of joined texts to texts, on Arrow batches), again and again until one is left.

    A call gets neighbouring parts of about `budget` tokens: a part counts at most half of that, so two meet at least and each round leaves half
    of the parts or fewer; where parts are long, each is first cut to the budget's half. Places come from running sums over ranges of (group, number), so a group of any
    number of parts is spread over tasks, and only what one call gets is ever gathered. A group of one part is reduced once. Null and blank parts
    go; a group without others has no row. Each round is written out, parts with their sizes, so that tokens are told once a part, not once for each pass over them.
    """
    reduce_fn, kind = reduce_fn or leading_tokens(budget // 4), parts.schema[group].dataType.simpleString()

    @F.pandas_udf("string")
    def reduced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(reduce_fn(x.tolist()), dtype=object)

    half = max(1, budget // 2)
    own = parts.where(F.trim(F.col(text)) != "").select(F.col(group).alias("g"), F.col(number).cast("long").alias("no"), F.col(text).alias("x"))
    weight = lambda n: F.least(F.lit(half), F.greatest(F.lit(1), n)).cast("long")
    cuts = F.when(F.col("n") > half, split_by_tokens(F.col("x"), half)).otherwise(F.array("x"))
    own = own.withColumn("n", count_tokens(F.col("x"))).select("g", "no", "n", F.posexplode_outer(cuts).alias("piece", "x"))  # an outer one isn't filtered by its argument, told twice
    own = cut(own.withColumn("w", weight(F.when(F.col("n") > half, count_tokens(F.col("x"))).otherwise(F.col("n")))).drop("n"), "parts")
    done = None
    for turn in range(1, rounds + 1):
        placed = running_sums(own, ["g"], ["no", "piece"], upto=F.col("w"))
        calls = placed.withColumn("call", F.floor((F.col("upto") - F.col("w")) / (2 * half)).cast("long")).groupBy("g", "call")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece", "x"))), lambda p: p["x"]), SEPARATOR)
        out = cut(calls.agg(joined.alias("x")).select("g", "call", reduced("x").alias("x")).withColumn("w", weight(count_tokens(F.col("x")))), "reduced")
        left = out.groupBy("g").agg(F.count("*").alias("n"))
        ready = out.join(left.where("n = 1").select("g"), out["g"].eqNullSafe(left["g"]), "left_semi").select(F.col("g").alias(group), F.col("x").alias(text), F.lit(turn).alias("rounds"))
        done = ready if done is None else done.unionByName(ready)
        more = left.where("n > 1").select(F.col("g").alias("g_"))
        own = out.join(more, F.col("g").eqNullSafe(F.col("g_")), "left_semi").select("g", F.col("call").alias("no"), F.lit(0).alias("piece"), "x", "w")
        if more.isEmpty():
            break
    return done.select(F.col(group).cast(kind).alias(group), text, "rounds")
