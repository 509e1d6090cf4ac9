"""Inventory of container files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.functions.text import file_stem
from jumptrail.operators.appid import EXTENSION
from jumptrail.sources.files import file_name
from jumptrail.sources.xml import partition_value


def scan_containers(spark: SparkSession, path: str, pattern: str = "*" + EXTENSION) -> DataFrame:
    """Container files of one directory, or of a directory per host: (host, file, appid, length, modified).

    The contents are never selected, so Spark lists the files and does not read them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = file_name()
    return files.select(
        F.coalesce(partition_value(F.col("_metadata.file_path"), "host"), F.lit("")).alias("host"),
        name.alias("file"),
        file_stem(name).alias("appid"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def scan_export(spark: SparkSession, path: str) -> DataFrame:
    """Files of a per-container XML export: (host, appid, file, length, modified)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xml")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    appid = F.coalesce(partition_value(F.col("_metadata.file_path"), "appid"), F.lit(""))
    return files.select(
        F.coalesce(partition_value(F.col("_metadata.file_path"), "host"), F.lit("")).alias("host"),
        appid.alias("appid"),
        F.concat(appid, F.lit(".xml")).alias("file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
