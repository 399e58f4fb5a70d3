"""Features and samples for scoring models: supervised bins, folds, target encoding, synthetic minority rows, imputation."""

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import bin_of, reference_edges
from .quantiles import running_sums
from .vector_blocks import QUERIES, nearest


def uniform(*of: str | Column) -> Column:
    """A number from 0 on below 1 from the text of the columns: the same at every run, and in any SQL with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c) if isinstance(c, str) else c for c in of)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def woe_table(rows: DataFrame, value: str, label: str, edges: Sequence[float], smoothing: float = 0.5) -> DataFrame:
    """bin, n, bad (label 1), rate, woe, iv (of the whole value): bins between edges, the last one of missing values, in one partial aggregate.

    woe is the log of the bin's share of bad rows over its share of good ones, with `smoothing` added to each count; rows without a label don't
    count; bins without rows have none.
    """
    k = len(edges) + 2
    own = rows.where(F.col(label).isNotNull()).groupBy(bin_of(F.col(value), edges).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("bad"))
    totals = own.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = totals.n or 0, totals.bad or 0
    share = lambda count, total: (count + smoothing) / (total + smoothing * k)
    out = own.withColumn("p", share(F.col("bad"), bad)).withColumn("q", share(F.col("n") - F.col("bad"), n - bad)).withColumn("woe", F.log(F.col("p") / F.col("q")))
    iv = F.lit(out.agg(F.sum((F.col("p") - F.col("q")) * F.col("woe"))).first()[0])  # of at most k rows
    return out.select("bin", "n", "bad", (F.col("bad") / F.col("n")).alias("rate"), "woe", iv.alias("iv"))


def pooled(counts: Sequence[tuple[float, float]], rising: bool = True) -> list[int]:
    """Which neighbouring (n, bad) stay apart when those whose rates go the wrong way are pooled: the first of each pool. Equal rates are one pool."""
    pools: list[list[float]] = []
    for i, (n, bad) in enumerate(counts):
        pools.append([i, n, bad])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1] if rising else pools[-2][2] * pools[-1][1] <= pools[-1][2] * pools[-2][1]):
            _, n, bad = pools.pop()
            pools[-1][1:] = pools[-1][1] + n, pools[-1][2] + bad
    return [int(p[0]) for p in pools]


def monotone_edges(rows: DataFrame, value: str, label: str, fine: int = 50, least: float = 0.02) -> list[float]:
    """Edges of bins whose rates of label 1 rise, or fall, from bin to bin, whichever parts the labels better: `fine` bins of equal counts by a sketch, then neighbours pooled on the driver, which has their counts only. Bins with less than a share `least` of the labelled rows join their neighbour first."""
    edges = reference_edges(rows.where(F.col(label).isNotNull()), value, fine)
    found = {r.bin: (r.n, r.bad) for r in woe_table(rows, value, label, edges).collect()}
    counts = [found.get(i, (0, 0)) for i in range(len(edges) + 1)]
    total = sum(n for n, _ in counts)
    firsts, sizes = [], []
    for i, (n, bad) in enumerate(counts):
        if firsts and (sizes[-1][0] < least * total or n == 0):
            sizes[-1] = (sizes[-1][0] + n, sizes[-1][1] + bad)
        else:
            firsts.append(i)
            sizes.append((n, bad))
    if len(sizes) > 1 and sizes[-1][0] < least * total:
        n, bad = sizes.pop()
        firsts.pop()
        sizes[-1] = (sizes[-1][0] + n, sizes[-1][1] + bad)

    def value_of(starts: list[int]) -> float:
        bad, good = sum(b for _, b in sizes), sum(n - b for n, b in sizes)
        out = 0.0
        for lo, hi in zip(starts, [*starts[1:], len(sizes)]):
            b, n = sum(s[1] for s in sizes[lo:hi]), sum(s[0] for s in sizes[lo:hi])
            p, q = (b + 0.5) / (bad + 0.5), (n - b + 0.5) / (good + 0.5)
            out += (p - q) * math.log(p / q)
        return out

    starts = max((pooled(sizes, up) for up in (True, False)), key=value_of)
    return [edges[firsts[s] - 1] for s in starts[1:]]


def stratified_folds(rows: DataFrame, stratum: str, id: str, k: int = 5, seed: str = "fold") -> DataFrame:
    """The rows with `fold`, 0 to k - 1: each stratum's rows are dealt in the order of a hash of the id, going on where the last stratum ended, so sizes of folds differ by one at most in each stratum and in all. A null is a stratum; rows with one id may part.

    Places come from running counts over ranges of (stratum, hash); no task orders a stratum.
    """
    keyed = rows.withColumn("key_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary")))
    return running_sums(keyed, [], [stratum, "key_", id], place_=F.lit(1)).withColumn("fold", ((F.col("place_") - 1) % k).cast("int")).drop("key_", "place_")


#: A category with a larger share of all rows is hot, so there are fewer than so many.
HOT = 1024


def target_encoding(rows: DataFrame, category: str, label: str, fold: str = "fold", weight: float = 10.0, into: str = "encoded") -> DataFrame:
    """The rows with the smoothed mean label of their category over all other folds: (sum + weight * mean) / (n + weight), with the mean of the other folds; so no row sees its own label, nor those of its fold.

    A category that other folds lack gets their mean. A null category is one as any other; rows without a label are encoded and don't count.
    Counts by category and fold are partial aggregates. Rows of hot categories, of which there are fewer than 1024, meet their counts by
    broadcast, so none gathers in a task; the rest by a join.
    """
    known = F.col(label).isNotNull().cast("long")
    cells = rows.groupBy(category, fold).agg(F.sum(known).alias("n_"), F.sum(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("s_"), F.count("*").alias("rows_"))
    folds = rows.groupBy(fold).agg(F.sum(known).alias("n"), F.sum(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("s")).collect()  # a row a fold
    total, sums, size = sum(r.n for r in folds), sum(r.s for r in folds), rows.count()
    mean = reduce(lambda c, r: F.when(F.col(fold).eqNullSafe(F.lit(r[fold])), F.lit((sums - r.s) / (total - r.n) if total > r.n else None)).otherwise(c), folds, F.lit(None).cast("double"))
    by = cells.groupBy(category).agg(F.sum("n_").alias("all_n"), F.sum("s_").alias("all_s"), F.sum("rows_").alias("all_rows")).withColumnRenamed(category, "category_")
    hot = by.where(F.col("all_rows") * HOT > size)
    names = [r.category_ for r in hot.select("category_").collect()]  # fewer than HOT
    out = []
    for part, own, hint in ((True, hot, F.broadcast), (False, by.where(F.col("all_rows") * HOT <= size), lambda x: x)):
        is_hot = reduce(Column.__or__, ((F.col(category).eqNullSafe(F.lit(v))) for v in names if v is None), F.coalesce(F.col(category).isin([v for v in names if v is not None]), F.lit(False)))
        mine = rows.where(is_hot if part else ~is_hot)
        stats = cells.join(own, F.col(category).eqNullSafe(F.col("category_"))).select("category_", F.col(fold).alias("fold_"), (F.col("all_n") - F.col("n_")).alias("n_"), (F.col("all_s") - F.col("s_")).alias("s_"))
        met = mine.join(hint(stats), F.col(category).eqNullSafe(F.col("category_")) & F.col(fold).eqNullSafe(F.col("fold_")))
        out.append(met.withColumn(into, (F.col("s_") + weight * F.coalesce(mean, F.lit(0.0))) / F.nullif(F.col("n_") + F.when(mean.isNull(), 0.0).otherwise(weight), F.lit(0.0))).select(*rows.columns, into))
    return out[0].unionByName(out[1])


def smote(rows: DataFrame, minority: Column, copies: int = 1, k: int = 5, seed: int = 0, index: str | None = None) -> DataFrame:
    """id, other, copy, share, vector: for each row (id, vector) of the minority `copies` synthetic vectors, each at a share of the way to one of its k nearest rows of the minority by cosine. Shares and neighbours come from a hash of id, copy and seed, so reruns agree.

    Neighbours are exact, by blocks of the minority against all of it, unless a folder for an index is given: that finds about the nearest, where the minority has more than some thousand rows. A row without a neighbour has no copies.
    """
    from . import vector_index

    own = rows.where(minority).select(F.col("id").alias("doc_id"), "vector")
    asked = own.select(F.col("doc_id").alias("query_id"), "vector")
    if index is None or own.count() <= QUERIES:
        near = nearest(asked, own, k + 1)
    else:
        vector_index.build_index(own, index)
        near = vector_index.search_index(asked, index, k + 1, id_type=own.schema["doc_id"].dataType.simpleString())
    lists = near.where("doc_id <> query_id").groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]), 1, k).alias("near"))  # k + 1 a row at most
    drawn = lists.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select("query_id", "copy", F.get("near", F.floor(uniform(F.lit(seed), "query_id", "copy", F.lit("near")) * F.size("near")).cast("int")).alias("other"), uniform(F.lit(seed), "query_id", "copy", F.lit("share")).alias("share"))
    a, b = own.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("a")), own.select(F.col("doc_id").alias("other"), F.col("vector").alias("b"))
    mixed = F.zip_with("a", "b", lambda x, y: x.cast("double") + F.col("share") * (y.cast("double") - x.cast("double")))
    return drawn.join(a, "query_id").join(b, "other").select(F.col("query_id").alias("id"), "other", "copy", "share", mixed.alias("vector"))


def impute(rows: DataFrame, columns: Sequence[str], rounds: int = 5, ridge: float = 1e-9) -> DataFrame:
    """The rows with nulls and NaNs of the columns filled: means first, then in each round the prediction of a linear regression of each column on all the others, as the round before has filled them, over the rows where it is known.

    A round is one pass that sums a Gram matrix a column over partitions; only those sums reach the driver. Fills follow from a row's own values
    and all rounds' coefficients, so a pass works them out anew and no table is written between rounds. A column without any value stays null and
    predicts nothing. Sums are taken about the means. `ridge` times its spread is added to each column's own entry, which settles columns that depend on one another.
    """
    p = len(columns)
    means = rows.agg(*(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns))).first()
    start, live = np.array([m if m is not None else 0.0 for m in means]), [i for i, m in enumerate(means) if m is not None]
    coefficients: list[np.ndarray] = []

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([b.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return x, np.isnan(x)

    def filled(x: np.ndarray, gone: np.ndarray, coefficients: list[np.ndarray]) -> np.ndarray:
        out = np.where(gone, start, x)
        for beta in coefficients:  # p x (p + 1), the last the constant
            out = np.where(gone, start + (out - start) @ beta[:, :p].T + beta[:, p], x)
        return out

    def sums_with(coefficients: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((p, p + 1, p + 1))
            for b in batches:
                x, gone = read(b)
                z = np.hstack([filled(x, gone, coefficients) - start, np.ones((len(x), 1))])
                for c in live:
                    seen = z[~gone[:, c]]
                    total[c] += seen.T @ seen
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "v"])

        return rows.select(*columns).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))

    for _ in range(rounds if len(live) > 1 else 0):
        gram = np.zeros(p * (p + 1) ** 2)
        for r in sums_with(coefficients).collect():  # p Gram matrices
            gram[r.at] = r.v
        gram, beta = gram.reshape(p, p + 1, p + 1), np.zeros((p, p + 1))
        for c in range(p):
            if c in live:
                on, g = [i for i in live if i != c], gram[c]
                mean = g[:, p] / g[p, p]
                spread = g - np.outer(mean, mean) * g[p, p]  # about the means of the rows that know the column
                a = spread[np.ix_(on, on)]
                beta[c, on] = np.linalg.lstsq(a + ridge * np.diag(np.diag(a)), spread[on, c], rcond=None)[0]
                beta[c, p] = mean[c] - mean[on] @ beta[c, on]
        coefficients.append(beta)
    out_schema = rows.select(*(F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in rows.columns)).schema

    def fill(batches: Iterator[pa.RecordBatch], coefficients: list[np.ndarray] = coefficients) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, gone = read(b)
            got = filled(x, gone, coefficients)
            arrays = [b.column(i) for i in range(b.num_columns)]
            for i, c in enumerate(columns):
                arrays[b.schema.get_field_index(c)] = pa.array(got[:, i]) if i in live else pa.nulls(len(x), pa.float64())
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return rows.mapInArrow(fill, out_schema)
