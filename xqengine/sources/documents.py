"""Documents from columns, files and record streams, as (doc_id, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_column(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))


def read_files(spark: SparkSession, path: str, glob: str = "*.xml", charset: str = "UTF-8") -> DataFrame:
    """One document a file; its path is its id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("doc_id"), F.decode("content", charset).alias("content"))


def read_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One document for each ``row_tag`` element (which must not nest) of large files.
    The text reader splits files at the closing tag, so one file is read by many tasks."""
    close = f"</{row_tag}>"
    rows = spark.read.option("lineSep", close).text(path).withColumn("_file", F.input_file_name())
    start = F.regexp_instr("value", F.lit(rf"<{row_tag}[\s>]"))
    body = F.concat(F.substr("value", start), F.lit(close))
    rows = rows.where(start > 0).select("_file", body.alias("content"))
    return rows.select(F.concat_ws("#", "_file", F.xxhash64("content").cast("string"), F.monotonically_increasing_id().cast("string")).alias("doc_id"), "content")
