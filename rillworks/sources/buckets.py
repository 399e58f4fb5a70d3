"""Collections in buckets by a hash of the key: a batch rewrites only the buckets that its keys fall into.

A commit writes the touched buckets to a new folder, then adds one file to the manifest with a row for each: version, bucket, folder (null for an
empty one), and the number of buckets, which stays. The last version of each bucket is current, so readers see a commit whole or not at all, and
what a reader has listed stays until `vacuum` removes what the last versions don't hold. One writer at a time.
"""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import upserted

BUCKETS = 256
_MANIFEST = "version long, bucket int, folder string, n_buckets int"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/MANIFEST")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, dict[int, str]]:
    """The last version (or the given one), the number of buckets, and the folder of each bucket that has rows: as many rows as there are buckets."""
    rows = _manifest(spark, path)
    if rows is None:
        return 0, 0, {}
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    found = rows.groupBy("bucket").agg(F.max("version").alias("v"), F.max(F.struct("version", "folder"))["folder"].alias("folder"), F.max("n_buckets").alias("n")).collect()
    return max((r.v for r in found), default=0), max((r.n for r in found), default=0), {r.bucket: r.folder for r in found if r.folder is not None}


def _read(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame | None:
    return spark.read.parquet(*(f"{path}/{f}/bucket={b}" for b, f in sorted(folders.items()))) if folders else None


def read_buckets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The collection's rows, now or at an earlier version that hasn't been vacuumed."""
    rows = _read(spark, path, current(spark, path, version)[2])
    if rows is None:
        raise ValueError(f"no rows at {path}")
    return rows


def _commit(path: str, keys: DataFrame, key: str, n_buckets: int, change: Callable[[DataFrame | None], DataFrame | None]) -> list[int]:
    """Rewrites the buckets of the keys; which these are."""
    spark = keys.sparkSession
    version, n, folders = current(spark, path)
    n = n or n_buckets
    at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in keys.select(at.alias("b")).distinct().collect())  # n at most
    rows = change(_read(spark, path, {b: folders[b] for b in touched if b in folders})) if touched else None
    if not touched:
        return []
    filled: set[int] = set()
    name = f"data-{uuid.uuid4().hex}"
    if rows is not None:
        rows.withColumn("bucket", at).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
        filled = {r.bucket for r in spark.read.schema("bucket int").parquet(f"{path}/{name}").distinct().collect()}
    marks = [(version + 1, b, name if b in filled else None, n) for b in touched]
    spark.createDataFrame(marks, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/MANIFEST")
    return touched


def upsert_buckets(rows: DataFrame, path: str, key: str = "chunk_id", version: str | None = None, n_buckets: int = BUCKETS) -> list[int]:
    """Idempotent, as upsert_chunks: the rows replace those of their keys. Returns the buckets that were rewritten. The number of buckets counts at the first write only."""
    return _commit(path, rows, key, n_buckets, lambda old: upserted(rows.limit(0) if old is None else old, rows, key, version))


def delete_keys(ids: DataFrame, path: str, key: str = "chunk_id") -> list[int]:
    """Rows of the keys go; buckets without any of them stay as they are."""
    return _commit(path, ids, key, BUCKETS, lambda old: None if old is None else old.join(ids.select(key).distinct(), key, "left_anti"))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes the folders of buckets that none of the last `keep` versions holds, which readers of older versions would lack; how many those were. A folder that a failed commit left behind goes too, so no writer may be at work."""
    last = current(spark, path)[0]
    held = {f"{f}/bucket={b}" for v in range(max(1, last - keep + 1), last + 1) for b, f in current(spark, path, v)[2].items()}
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for folder in fs.globStatus(fs_path(f"{path}/data-*")) or []:
        own = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.isDirectory() and s.getPath().getName().startswith("bucket=")]
        dead = [p for p in own if f"{folder.getPath().getName()}/{p.getName()}" not in held]
        gone += sum(bool(fs.delete(p, True)) for p in dead)
        if len(dead) == len(own):
            fs.delete(folder.getPath(), True)
    return gone
