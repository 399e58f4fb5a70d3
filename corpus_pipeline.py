"""From documents to shards: language, near copies, benchmark leaks, mixing, sharding. Each stage is written and read again as the next one's input."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillworks.llm._scratch import stored
from rillworks.llm.decontaminate import build_index, find_leaks
from rillworks.llm.jaccard_join import jaccard_components
from rillworks.llm.language_id import fit_language_model, fold, identify_language
from rillworks.llm.mix_sources import mix_sources
from rillworks.llm.shards import shard


#: Rows of keys to drop, or of files, up to which they are sent to all tasks.
FEW = 1 << 20


def free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key for each row, as ids may be null or repeat, and the key's name: the number of the row's file and its place in it, the same at every reading. Rows of no file are written first."""
    row = free(docs, "row")
    try:
        read = docs.select("*", F.col("_metadata.file_path").alias(free(docs, "file")), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return keyed(stored(docs, "rows"))
    file = free(docs, "file")
    files = stored(read.select(file).distinct().select(file, F.row_number().over(W.orderBy(file)).cast("long").alias("number")), "files")  # a row for each file
    files = F.broadcast(files) if files.count() <= FEW else files
    number = free(docs, "number")
    rows = read.join(files.withColumnRenamed("number", number), file)
    return rows.select(*docs.columns, F.shiftleft(number, 40).bitwiseOR(F.col(row)).alias(row)), row


def without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The rows whose key isn't in gone (row). Texts are shuffled only if the keys are too many to send to all tasks."""
    gone = stored(gone.select(F.col("row").alias(row)).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, row, "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language and those that lie between two go; the model learns from three quarters of the rows with a language. Rows are judged one by one, also those without an id or with the same; other columns stay as they are."""
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)))
    rows, row = keyed(docs)
    found = identify_language(rows, model, id_col=row, gap=0.05).withColumnRenamed("doc_id", "row")
    return without(rows, found.where("lang_pred = 'und' or ambiguous"), row).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest doc_id stays, once, a null one only if there is no other; so do all texts without words. Equal ids with texts that don't link stay. Rows of equal id and text stay once, with all columns of one of them."""
    rows, row = keyed(docs)
    found = jaccard_components(rows, id_col=row).select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
    found = found.join(rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("name")), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    # one group a component; texts without words, which link with nothing, are one by id and text
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"), F.when(F.col("n_shingles") == 0, F.struct("doc_id", "name")).alias("e")]
    stays = found.groupBy(*group).agg(first.alias("row"))
    return without(rows, found.select("row").join(stays.select("row"), "row", "left_anti"), row).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row, also those without an id or with the same; other columns stay as they are."""
    rows, row = keyed(docs)
    leaks = find_leaks(rows, build_index(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), id_col=row).withColumnRenamed("doc_id", "row")
    return without(rows, leaks, row).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stands as often as the mix takes it whole; the one that crosses its source's end stands once more if at least half of it is taken. Null ids and rows that repeat one are taken each by itself; other columns are repeated with the row."""
    rows, row = keyed(docs)
    copies, copy = free(docs, "copies"), free(docs, "copy")
    mix = mix_sources(rows, row_col=row).select(F.col("row").alias(row), F.round(F.col("taken") / F.greatest(F.lit(1), "size")).cast("int").alias(copies))
    return rows.join(mix.where(F.col(copies) > 0), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it."""
    return shard(docs, 8)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the language model and the latent index are trained; tests hold the result against plain versions.
ORACLE_SQL = None
