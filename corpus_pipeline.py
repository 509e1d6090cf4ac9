"""The corpus pipeline: each stage works on all that the one before it kept, and all but the last return documents.

Documents without letters, or in none of the languages learned, go; repeated lines are cut, and documents that held
no other words go; of near-duplicates the one with the smallest id stays; documents that hold a passage of the benchmark
go; what is left is packed into sequences. Other columns, whatever their names, are carried along unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.llm.decontamination import contamination, document_key
from jumptrail.llm.language import UNDETERMINED, fit, identify
from jumptrail.llm.lines import repeated_lines, without_lines
from jumptrail.llm.near_duplicates import near_duplicates
from jumptrail.llm.packing import pack_documents
from jumptrail.shared import fresh_path, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages learned; a class of its own, taught from shuffled bytes, random letters
    and other scripts, takes what is none of them."""
    found = identify(docs.select(F.struct("*").alias("row"), "text"), fit(docs, rejecting=True))
    return found.filter(F.col("lang_pred") != UNDETERMINED).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of lines, however short; a document of which only spaces and empty lines are left goes."""
    lines = repeated_lines(docs.select("doc_id", "text"), least_words=1)
    others = {name: F.col(f"`{name.replace('`', '``')}`") for name in docs.columns if name not in ("doc_id", "text")}
    rest = F.struct(F.lit(0).alias("_"), *[column.alias(f"_{n}") for n, column in enumerate(others.values())])
    found = without_lines(docs.select(rest.alias("rest"), "doc_id", "text"), lines)
    found = found.filter((F.col("_removed") == 0) | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    values = {name: F.col(f"rest._{n}") for n, name in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("_kept")}
    if "n_chars" in others:
        values["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[values[name].alias(name) for name in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; texts that share an id are
    judged each, and rows that repeat id and text stay once."""
    keyed = docs.select(document_key().alias("k"), "doc_id", "text")
    found = near_duplicates(keyed.select(F.col("k").alias("doc_id"), "text"))
    groups = written(found.select(F.col("doc_id").alias("k"), "component_id").distinct(), "groups")
    ids = keyed.select("k", "doc_id").distinct().join(groups, "k")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first")).select("first.k")
    rows = docs.select(F.struct("*").alias("row"), document_key().alias("k"))
    return rows.join(first, "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go."""
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(F.struct("*").alias("row"), document_key().alias("k"))
    return rows.join(found.filter("contaminated").select("k").distinct(), "k", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# A trained network, similarity over hashes and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
