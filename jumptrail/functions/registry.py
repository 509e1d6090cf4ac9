"""The functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from jumptrail.functions import crc64 as crc64_module


def register_functions(spark: SparkSession) -> None:
    """`appid_crc64(text)`: BIGINT bits; `ltrim('0', hex(appid_crc64(text)))` is the AppID."""
    spark.udf.register("appid_crc64", crc64_module._crc64)
