"""Tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine only, as in tests, a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rillworks.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-rillworks-")
        spark.conf.set("spark.rillworks.scratch", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: a cut in the lineage that outlives executors. The tables stay until the folder is cleared."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """A stored table that nothing reads any more goes."""
    hadoop = df.sparkSession._jsc.hadoopConfiguration()
    for folder_of in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder_of)
        path.getFileSystem(hadoop).delete(path, True)
