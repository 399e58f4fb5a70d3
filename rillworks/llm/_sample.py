"""Bounded samples of labelled rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each label at most, chosen by a hash of the key: the same ones at every run."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(label) == F.lit(k), min(1.0, most / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
