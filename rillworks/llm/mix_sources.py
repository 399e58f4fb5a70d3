"""Mixing of sources to target weights: complete epochs, then Efraimidis-Spirakis samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._native import words
from ._scratch import stored

#: Ranges of keys within an octave, and within the range with the end; sources up to which their table is broadcast.
RANGES, FINER, BROADCAST = 256, 4096, 20_000


def quality(text: Column) -> Column:
    """A text's weight: the share of characters that are not of #*$%&|<>, at least 0.05."""
    return F.coalesce(F.greatest(F.lit(0.05), F.length(F.translate(text, "#*$%&|<>", "")) / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size, target for rows of source, source_size: sources by code point, null last, weigh `weights` in turn and share the sum of
    all sizes; a target stops at `most` times the source's size, and the excess is shared again by weight until none is above.

    That is one level for all sources below their stop, found from the sources in the order in which they reach it.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("stop", most * F.col("source_size")).withColumn("at", F.col("stop") / F.col("w"))
    order = W.orderBy("at", F.col("source").isNull(), "source")
    before, rest, all_rows = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source that doesn't reach its stop sets the level
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "source", "level"))).over(all_rows)["level"]
    return rows.withColumn("target", F.least(F.col("stop"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3, weight: Column | None = None, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for each row: the words that the mix takes of it, repeats counted.

    A row's size is its number of words, 0 for null and empty texts. Its source's whole epochs take all of it each time; what is left of the
    target goes to rows by the key -ln(u) / weight, u from a hash of the id, the least first, and the row that crosses the end gives the words
    still wanted. So a source's taken words are its target, rounded. A null source is a source; rows without an id have u from their text. Rows that repeat
    an id count one by one; reruns agree. A column that tells rows apart (row_col, as `row`) is handed through; others are ignored.

    A source's rows are never sorted in one task: sums over RANGES ranges in each octave of the key, of which none holds more than about 0.2 % of the rows at
    any scale of weights, find the range that holds the end, sums over FINER ranges in it the finer one, and only that is sorted. The sources' own table has one row each
    and is ordered in one task: thousands of sources, not one for each document.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.coalesce(F.sha2(F.col(text_col), 256), F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed), name).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / float((1 << 52) + 2)
    key = -F.log(u) / (quality(F.col(text_col)) if weight is None else F.greatest(weight, F.lit(1e-6)))
    own = [] if row_col is None else [F.col(row_col).alias("row")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *own, F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("at", RANGES * F.log2("key")).withColumn("range", F.floor("at").cast("int")).withColumn("fine", F.floor(FINER * (F.col("at") - F.col("range"))).cast("int"))
    rows = stored(rows.drop("at"), "sizes")
    ranges = stored(rows.groupBy("source", "range").agg(F.sum("size").alias("n")), "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    goal = goal.withColumn("left", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    goal = _with_end(goal.withColumn("before", F.lit(0).cast("long")), ranges, "range")
    inner = rows.join(small(goal.select(F.col("source").alias("s"), "end_range")), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("end_range")))
    goal = small(_with_end(goal, inner.groupBy("source", "fine").agg(F.sum("size").alias("n")), "fine").withColumnRenamed("source", "s"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    at_end = F.coalesce((F.col("range") == F.col("end_range")) & (F.col("fine") == F.col("end_fine")), F.lit(False))
    inside = F.col("end_range").isNull() | (F.col("range") < F.col("end_range")) | (F.col("range") == F.col("end_range")) & (F.col("fine") < F.col("end_fine"))
    plain = rows.where(~at_end).withColumn("part", F.when(inside, F.least("size", "left")).otherwise(F.lit(0)))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "size", *(["row"] if own else [])).rowsBetween(W.unboundedPreceding, 0))
    last = rows.where(at_end).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before") - (upto - F.col("size")))))
    return plain.unionByName(last).select("doc_id", "source", "size", "source_size", "target", "epochs", *(["row"] if own else []), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def small(goal: DataFrame) -> DataFrame:
    """The table of sources, written, and broadcast if it is counted small."""
    goal = stored(goal, "targets")
    return F.broadcast(goal) if goal.count() <= BROADCAST else goal


def _with_end(goal: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """goal with the range in which a source's running sum passes what is left of its target, null if it never does, and `before` moved on to that range's begin."""
    g = goal.select(F.col("source").alias("s"), "left", "before")
    upto = ranges.select("source", name, "n", F.sum("n").over(W.partitionBy("source").orderBy(name)).alias("upto")).join(g, F.col("source").eqNullSafe(F.col("s")))
    end = upto.where("before + upto > left").groupBy("s").agg(F.min(F.struct(name, F.expr("before + upto - n AS before"))).alias("end"))
    return goal.join(end, F.col("source").eqNullSafe(F.col("s")), "left").withColumn(f"end_{name}", F.col(f"end.{name}")).withColumn("before", F.coalesce("end.before", "before")).drop("s", "end")
