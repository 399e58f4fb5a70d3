"""Readers and writers."""

import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pages_of(rows: DataFrame, order: str, filename: str = "filename", text: str = "text") -> DataFrame:
    """Pages numbered from 1 within their file in the given order; blank ones keep their number and go."""
    page = F.row_number().over(W.partitionBy(filename).orderBy(order)).cast("int")
    return rows.withColumn("page", page).where(F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")) > 0)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """filename, page, text of text files whose pages end with form feeds."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("filename"), F.posexplode(F.split("value", "\f")).alias("page", "text"))
    return files.withColumn("page", F.col("page") + 1).where(F.length(F.regexp_replace("text", r"\s+", "")) > 0)


def parse_pages(files: DataFrame, page_parser: Callable[[bytes], list[tuple[int, str]]], most: int = 4 << 20) -> DataFrame:
    """filename, page, text, error of files (path, content), such as `binaryFile` gives, by a user's parser of bytes to (page, text).

    Blank pages go. A file that the parser fails on has one row with its error and no page, and the others go on; null content is such a file.
    Files come to the parser one by one, and rows leave in batches of about `most` bytes; how many bytes of files an Arrow batch brings is bounded by
    spark.sql.execution.arrow.maxBytesPerBatch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                name = (path.as_py() or "").rsplit("/", 1)[-1]
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    rows = [(name, int(page), str(text), None) for page, text in page_parser(content.as_py()) if text and text.strip()]
                except Exception as e:  # noqa: BLE001  the user's parser may raise anything
                    rows = [(name, None, None, f"{type(e).__name__}: {e}"[:500])]
                for r in rows:
                    held.append(r)
                    size += len(r[2] or r[3])
                    if size >= most:
                        yield _pages(held)
                        held, size = [], 0
        if held:
            yield _pages(held)

    return files.select("path", "content").mapInArrow(run, "filename string, page int, text string, error string")


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["filename", "page", "text", "error"])


def read_documents(spark: SparkSession, path: str, page_parser: Callable[[bytes], list[tuple[int, str]]], pattern: str = "*") -> DataFrame:
    """parse_pages over all files below a path whose names fit the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return parse_pages(files, page_parser)


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """image_id, split, class_id, xc, yc, w, h from text files of normalised boxes; blank lines go. Their folder's name, or its parent's if it is `labels`, is the split."""
    line = F.split(F.trim("value"), r"\s+")
    name = F.col("file")
    folder = F.when(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1) == "labels", F.regexp_extract(name, r"([^/]+)/labels/[^/]+$", 1)).otherwise(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1))
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    return rows.select(F.regexp_extract(name, r"([^/]+)\.txt$", 1).alias("image_id"), folder.alias("split"), line[0].cast("int").alias("class_id"), *(line[i + 1].cast("double").alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))))


def read_qc_labels(spark: SparkSession, path: str) -> DataFrame:
    """filename, defect_type, box_no, x, y, w, h: a row for each box, one of nulls for an image without."""
    rows = spark.read.csv(path, header=True, schema="filename string, defect_type string, bboxes_xywh string")
    boxes = F.filter(F.split(F.coalesce("bboxes_xywh", F.lit("")), ";"), lambda b: F.trim(b) != "")
    rows = rows.select("filename", "defect_type", F.posexplode_outer(F.when(F.size(boxes) > 0, boxes)).alias("box_no", "box"))
    return rows.select("filename", "defect_type", "box_no", *(F.trim(F.split("box", ",")[i]).cast("double").alias(c) for i, c in enumerate("xywh")))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file_name, category, x, y, w, h of COCO annotations; images without any have nulls."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    images, notes, kinds = (raw.select(F.explode(c).alias("x")).select("x.*") for c in ("images", "annotations", "categories"))
    boxes = notes.join(kinds.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left").select(F.col("image_id").alias("id"), "category", *(F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")))
    return images.join(boxes, "id", "left").withColumnRenamed("id", "image_id")


def read_image_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, label (the file's folder), class_id (place among the distinct labels), content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    names = rows.select("label").distinct()
    return rows.join(names.withColumn("class_id", F.row_number().over(W.orderBy("label")) - 1), "label").select("path", "label", "class_id", "content")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, question string, ground_truth string, ground_truth_contexts array<string>, metadata struct<ticker:string,period:string,difficulty:string,requires_math:boolean>"
    return spark.read.schema(schema).json(path, multiLine=True)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The existing rows without those of incoming keys, and of each incoming key one row: the last version; of equal ones, or without a version, the one with the highest hash."""
    order = [*([F.desc(version)] if version else []), F.desc(F.xxhash64(*incoming.columns))]  # the same row at every run
    last = incoming.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.join(incoming.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(last.select(existing.columns))


def _there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What a path holds; None only if there is no such path, while any other failure is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _pointer(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last version and its snapshot; 0 and None for a new collection."""
    marks = _there(lambda: spark.read.schema("version long, name string").json(f"{path}/CURRENT"))
    last = marks.agg(F.max(F.struct("version", "name")).alias("x")).first().x if marks is not None else None
    if last is not None:
        return last.version, last.name
    if _there(lambda: spark.read.parquet(f"{path}/snapshot-*")) is not None:
        raise ValueError(f"{path} has snapshots but none is marked as current")
    return 0, None


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection's current snapshot."""
    name = _pointer(spark, path)[1]
    if name is None:
        raise ValueError(f"no collection at {path}")
    return spark.read.parquet(f"{path}/{name}")


def replace_collection(rows: DataFrame, path: str) -> None:
    """Writes a new snapshot, then adds a mark with the next version: readers see the old one or the new one, and a mark once written is never taken away. One writer at a time."""
    spark = rows.sparkSession
    version, name = _pointer(spark, path)[0] + 1, f"snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(version, name)], "version long, name string").coalesce(1).write.mode("append").json(f"{path}/CURRENT")


def upsert_chunks(rows: DataFrame, path: str, key: str = "chunk_id", version: str | None = None) -> None:
    """Idempotent: a repeated write with the same keys replaces their rows. Of a key that comes twice the last version is written, also the first time."""
    name = _pointer(rows.sparkSession, path)[1]
    old = rows.limit(0) if name is None else rows.sparkSession.read.parquet(f"{path}/{name}")
    replace_collection(upserted(old, rows, key, version), path)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def delete_document(spark: SparkSession, path: str, ids: DataFrame, key: str = "doc_id") -> None:
    replace_collection(without(read_collection(spark, path), ids, key), path)


def list_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, filename, chunk_count, upload_time: every document, without a cap."""
    return chunks.groupBy("doc_id", "filename").agg(F.count("*").alias("chunk_count"), F.max("upload_time").alias("upload_time"))


def get_points(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def set_payload(rows: DataFrame, ids: DataFrame, key: str, values: Mapping[str, Any | Column]) -> DataFrame:
    """The rows with columns overwritten for the given ids."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumns({k: F.when(F.col("_hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}).drop("_hit")


def write_markdown(rows: DataFrame, most: int = 50) -> DataFrame:
    """One row: the first `most` rows as a Markdown table."""
    from ..functions.text import json_to_markdown

    few = rows.limit(most)
    return few.agg(json_to_markdown(F.to_json(F.collect_list(F.struct(*rows.columns))), most).alias("table"))
