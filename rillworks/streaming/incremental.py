"""The operators that also take streams: rates, defect rates, ingestion."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import defect_rate
from ..operators.drift import value_drift
from ..operators.usage import rate_violations, sketched_metrics
from ..sources.io import upsert_chunks


def stream_rate_violations(rows: DataFrame, key: str, every: str = "1 minute", most: int = 120, late: str = "10 minutes") -> DataFrame:
    return rate_violations(rows.withWatermark("ts", late), key, every, most)


def stream_defect_rate(rows: DataFrame, every: str = "1 hour", alert: float = 0.05, late: str = "10 minutes") -> DataFrame:
    return defect_rate(rows.withWatermark("ts", late), every, alert)


def stream_metrics(rows: DataFrame, by: Sequence[str] = ("route", "key"), every: str = "1 hour", late: str = "10 minutes", **how) -> DataFrame:
    """Calls, errors, cost and quantiles of ms by route or stage, in append mode: each span once, when the watermark has passed its end."""
    return sketched_metrics(rows.withWatermark("ts", late), by, every, **how)


def stream_drift(rows: DataFrame, reference: DataFrame, value: str, every: str = "1 hour", late: str = "10 minutes", **how) -> DataFrame:
    """Each span's drift against a fixed reference table."""
    return value_drift(rows.withWatermark("ts", late), reference, value, every, **how)


def stream_ingest(chunks: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", upsert: Callable[[DataFrame, str, str], object] = upsert_chunks) -> StreamingQuery:
    """Each batch of chunks goes through the same idempotent upsert as a batch job's, so a batch that runs again changes nothing; with `sources.buckets.upsert_buckets` it rewrites only the buckets that it touches."""
    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: upsert(rows, path, key)).start()
