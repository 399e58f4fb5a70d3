"""Classification results, losses, splits and pixels."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import let
from .quantiles import running_sums

# Channel means and deviations.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def classification_report(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support for each class, then `macro avg` and `weighted avg`; 0 where there is nothing to divide by."""
    n = confusion(rows, label, predicted)
    each = n.select(F.explode(F.array(F.struct(F.col(label).cast("string").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(F.lit(0).cast("long")).alias("hit")), F.struct(F.col(predicted).cast("string").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("e"))
    each = each.groupBy(F.col("e.c").alias("class")).agg(F.sum("e.support").alias("support"), F.sum("e.called").alias("called"), F.sum("e.hit").alias("hit"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    each = each.withColumn("precision", part("hit", "called")).withColumn("recall", part("hit", "support"))
    each = each.withColumn("f1", F.when(F.col("hit") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).select("class", "precision", "recall", "f1", "support")
    macro = each.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("class"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def overfit_gap(train: Column, validation: Column, most: float = 0.1) -> Column:
    return F.struct((train - validation).alias("gap"), (train - validation > most).alias("overfit"))


def softmax(logits: Column) -> Column:
    return let(F.struct(logits.alias("x"), F.array_max(logits).alias("m")), lambda s: let(F.transform(s["x"], lambda x: F.exp(x - s["m"])), lambda e: let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("n")), lambda t: F.transform(t["e"], lambda y: y / t["n"]))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-ln of the softmax at the label (from 0), computed with the largest logit taken off."""
    return let(F.struct(logits.alias("x"), F.array_max(logits).alias("m")), lambda s: s["m"] + F.log(F.aggregate(F.transform(s["x"], lambda x: F.exp(x - s["m"])), F.lit(0.0), lambda a, y: a + y)) - F.get(s["x"], label))


def mean_loss(batches: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    """The mean over samples of batches' mean losses."""
    return batches.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def pixel_iou(pixels: DataFrame, classes: Sequence[int], smooth: float = 1e-6) -> DataFrame:
    """class, iou, dice over rows of truth and predicted class of a pixel; an empty union gives 1."""
    sums = [F.struct(F.lit(c).alias("class"), *(F.sum(F.when(t, 1).otherwise(0)).alias(k) for k, t in (("both", (F.col("truth") == c) & (F.col("predicted") == c)), ("t", F.col("truth") == c), ("p", F.col("predicted") == c)))) for c in classes]
    out = pixels.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    union = F.col("t") + F.col("p") - F.col("both")
    return out.select("class", F.when(union == 0, 1.0).otherwise(F.col("both") / F.nullif(union, F.lit(0))).alias("iou"), ((2 * F.col("both") + smooth) / (F.col("t") + F.col("p") + smooth)).alias("dice"))


def split_80_20(rows: DataFrame, key: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """The rows with split: exactly int(share * n) are `train`, by a hash of key and seed. Ranges of the hash are counted first; only the one with the cut is ordered."""
    rows = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_r", F.shiftright("_h", 52))
    counts = rows.groupBy("_r").agg(F.count("*").alias("n")).select("_r", (F.sum("n").over(W.orderBy("_r")) - F.col("n")).alias("_before"), F.sum("n").over(W.orderBy("_r")).alias("_upto"), F.sum("n").over(W.partitionBy()).alias("_all"))
    rows = rows.join(F.broadcast(counts), "_r")  # at most 4096 rows
    cut = F.floor(F.col("_all") * share)
    whole = rows.where((F.col("_upto") <= cut) | (F.col("_before") >= cut)).withColumn("split", F.when(F.col("_upto") <= cut, "train").otherwise("validation"))
    part = rows.where((F.col("_upto") > cut) & (F.col("_before") < cut)).withColumn("_n", F.col("_before") + F.row_number().over(W.partitionBy("_r").orderBy("_h", key)))
    part = part.withColumn("split", F.when(F.col("_n") <= cut, "train").otherwise("validation")).drop("_n")
    return whole.unionByName(part).drop("_h", "_r", "_before", "_upto", "_all")


def mixup(rows: DataFrame, pairs: DataFrame, weight: float = 0.6) -> DataFrame:
    """id, x, y: each row (id, x, y) mixed with its partner of pairs (id, other)."""
    other = rows.select(F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    mix = lambda a, b: F.zip_with(a, b, lambda p, q: weight * p.cast("double") + (1 - weight) * q.cast("double"))
    return rows.join(pairs, "id").join(other, "other").select("id", mix("x", "_x").alias("x"), mix("y", "_y").alias("y"))


def beta_quantile(u: np.ndarray, alpha: float, steps: int = 1 << 12) -> np.ndarray:
    """The value of a Beta(alpha, alpha) variable at the shares u, from its running sum in steps of x ** alpha, in which the density has no pole."""
    s = np.linspace(0.0, 0.5**alpha, steps + 1)
    density = (1 - s ** (1 / alpha)) ** (alpha - 1)
    upto = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    low = np.minimum(u, 1 - u)
    x = np.interp(2 * low * upto[-1], upto, s) ** (1 / alpha)
    return np.where(u <= 0.5, x, 1 - x)


def mixup_permuted(rows: DataFrame, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """id, other, weight, x, y: each row (id, x, y) mixed with the row at its place of a seeded permutation, at a weight from Beta(alpha, alpha); reruns agree.

    A permutation is two orders by hashes: rows of equal places are partners. Places come from running counts over ranges of the hashes. Ids are unique.
    """
    order = lambda name: F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), "id").cast("binary"))
    place = lambda name, id: running_sums(rows.select(F.col("id").alias(id), order(name).alias("_h")), [], ["_h", id], _place=F.lit(1)).select(id, "_place")

    @F.pandas_udf("double")
    def weight(u: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(u.to_numpy(), alpha))

    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("weight"), "id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    pairs = place("first", "id").join(place("second", "other"), "_place").select("id", "other", weight(share).alias("weight"))
    other = rows.select(F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    mix = lambda a, b: F.zip_with(a, b, lambda p, q: F.col("weight") * p.cast("double") + (1 - F.col("weight")) * q.cast("double"))
    return rows.join(pairs, "id").join(other, "other").select("id", "other", "weight", mix("x", "_x").alias("x"), mix("y", "_y").alias("y"))


def channel_normalize(pixels: Column) -> Column:
    """A flat height by width by 3 array of 0 to 255 as three planes, each less its mean over its deviation."""
    n = F.size(pixels)
    order = F.concat(*(F.sequence(F.lit(c + 1), n - 2 + c, F.lit(3)) for c in range(3)))
    mean, std = F.array(*map(F.lit, CHANNEL_MEAN)), F.array(*map(F.lit, CHANNEL_STD))
    return F.transform(order, lambda i: (F.element_at(pixels, i) / 255.0 - F.get(mean, (i - 1) % 3)) / F.get(std, (i - 1) % 3))


def standardize(rows: DataFrame, column: str) -> DataFrame:
    """The column less its mean over its population deviation; null if that is 0."""
    stats = rows.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return rows.crossJoin(F.broadcast(stats)).withColumn(column, (F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def misclassified(rows: DataFrame, n: int = 12, key: str = "id", label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.where(F.col(label) != F.col(predicted)).orderBy(key).limit(n)
