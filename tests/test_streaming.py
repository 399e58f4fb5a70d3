from pyspark.sql import functions as F

from rillworks.operators.usage import rate_violations
from rillworks.sources.io import read_collection
from rillworks.streaming import incremental


def test_rates_as_in_batch(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3) * F.when(F.col("id") % 3 == 0, 1).otherwise(30)).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = incremental.stream_rate_violations(source, "key", most=20, late="1 day")
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("rates").collect()))
    assert got == sorted(map(tuple, rate_violations(rows, "key", most=20).collect())) and got


def test_ingest_is_idempotent(spark, tmp_path):
    for k, part in enumerate(([("a", 1), ("b", 1)], [("b", 2)])):
        spark.createDataFrame(part, "chunk_id string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("chunk_id string, v int").parquet(str(tmp_path / "in"))
        incremental.stream_ingest(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, read_collection(spark, str(tmp_path / "out")).collect())) == [("a", 1), ("b", 2)]
