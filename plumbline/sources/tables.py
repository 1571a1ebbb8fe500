"""Readers of the tables that queries run over, and sinks that replace what they write again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as page_functions
from ..operators import changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table as a stream of its files, so many in a batch: a folder of part files, or one file (then its folder is read, by its name)."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return source.parquet(path)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records of the pages table."""
    return page_functions.page_model(table(spark, sf_dir, "pages"))


def repository_files(spark: SparkSession, path: str, suffixes: str = "*.{py,ts,tsx,js,jsx,md,html,css,json,yaml,yml,php}") -> DataFrame:
    """path, length, text, language of a repository's files, without what a scan skips."""
    root = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(path)
    relative = F.regexp_replace("path", f"^(?:file:)?/*{root.lstrip('/')}/", "")
    rows = rows.select(relative.alias("path"), "length", "content")
    kept = rows.filter(changes.skip_reason(F.col("path"), F.col("length")).isNull())
    return kept.select("path", "length", F.decode("content", "UTF-8").alias("text"), changes.language_of(F.col("path")).alias("language"))


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """reason, n for the files that a scan does not read; contents are not read either."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.groupBy(changes.skip_reason(F.col("path"), F.col("length")).alias("reason")).agg(F.count("*").alias("n")).filter("reason is not null")


def write_pages(records: DataFrame, path: str, run: str) -> None:
    """The page sink: nested columns, one partition for each crawl run, written again as a whole."""
    records.withColumn("crawl_run", F.lit(run)).write.partitionBy("crawl_run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
