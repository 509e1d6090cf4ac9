"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# For tables of whole entries and documents.
SMALL = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a folder of its own in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="jumptrail-"))
    return context.getCheckpointDir()


# What each application has made in its shared folder, and the tables it keeps there with their folders.
_MADE: dict[int, list[str]] = {}
_TABLES: dict[int, dict[str, str]] = {}

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(id(spark.sparkContext), []).append(path)
    return path


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go when the table stands; until then lost ones are made anew as ever."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def few_rows(spark: SparkSession, schema: str, **columns: Sequence) -> DataFrame:
    """A small frame of the driver's, planned as a local table: no Python worker starts to read it."""
    return spark.createDataFrame(pa.table({name: pa.array(values) for name, values in columns.items()}), schema)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows, as a local table too."""
    return spark.range(0).select(*(F.lit(None).cast(field.dataType).alias(field.name) for field in StructType.fromDDL(schema)))


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe to read many times. Rows that are many and
    read seldom are worth a codec that takes longer to write and less room."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with releasing(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str], codec: str | None = None) -> str:
    """The rows as a bucketed and sorted table in the shared folder; its name."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    _TABLES.setdefault(id(spark.sparkContext), {})[table] = path
    with releasing(spark):
        (df.write.option("compression", codec) if codec else df.write).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return table


def unbucketed(spark: SparkSession, table: str) -> None:
    """Drop a bucketed table and delete its files, when nothing reads them any more."""
    path = _TABLES[id(spark.sparkContext)].pop(table)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder, where there is one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results not yet computed can no longer be."""
    application = id(spark.sparkContext)
    for table in _TABLES.pop(application, {}):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _MADE.pop(application, []):
        remove(spark, path)
