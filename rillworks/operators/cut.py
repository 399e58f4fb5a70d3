"""Cuts in the lineage of iterative operators."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, on one machine only, below a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rillworks.cuts", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-rillworks-")
        spark.conf.set("spark.rillworks.cuts", at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written to scratch and read again."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows that grow with the graph: a join with them is by shuffles. Files of little size may hold many rows, so the planner would send them whole through the driver, in each round again."""
    return rows.hint("merge")
