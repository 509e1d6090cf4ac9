"""What an export and an ingest move and write."""

from __future__ import annotations

from pyspark.sql import functions as F

from jumptrail.operators.documents import documents, split_incomplete, split_unwritable
from jumptrail.shared import written
from jumptrail.sources import xml


def records(spark):
    ids = spark.range(40_000).select(
        "id", F.lit("H").alias("host"), F.concat(F.lit("a"), (F.col("id") % 4000).cast("string")).alias("appid"),
        F.expr("id div 4000 + 1").alias("position"),
    )
    odd = F.when(F.col("id") % 4000 == 7, F.lit("\x01")).otherwise(F.sha2(F.col("id").cast("string"), 512))
    entries = ids.select("host", "appid", "position", F.col("id").alias("entry_number"), odd.alias("path"), F.expr("timestamp_ntz'2024-01-01 10:00:00.5'").alias("last_modified"))
    lnks = ids.filter("id % 3 = 0").select(
        "host", "appid", "position", F.lit("C:\\x").alias("local_base_path"), F.lit(None).cast("string").alias("name_string"), F.lit("").alias("arguments")
    )
    return entries, lnks


def test_a_few_bad_containers_move_no_documents(spark):
    docs = written(documents(*records(spark)), "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        good, bad = split_unwritable(docs)
        short = docs.withColumn("_corrupt_record", F.when(F.col("appid") == "a5", "x")).withColumns({"raw": F.lit("x"), "file": F.lit("f")})
        whole, left = split_incomplete(short)
        for part in (good, whole, left):
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert good.count() == 3999 and [r.appid for r in bad.collect()] == ["a7"]
    assert whole.count() == 3999 and [r.appid for r in left.collect()] == ["a5"]


def test_records_move_as_they_come_and_are_written_as_text(spark):
    docs = documents(*records(spark))
    moved = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(entry" in moved and "_LastModified" not in moved[moved.index("Union") :]
    one = docs.filter("appid = 'a3'").collect()[0]
    first = one.DestList.DestListEntryV2[0]
    assert (first._EntryNumber, first._LastModified) == ("3", "2024-01-01 10:00:00.5")
    assert [int(e._EntryNumber) for e in one.DestList.DestListEntryV2] == [3 + 4000 * n for n in range(10)]
    link = one.LNKs.LNK[0]
    assert (link.LinkInfo._LocalBasePath, link.NAME_STRING, link.COMMAND_LINE_ARGUMENTS._String) == ("C:\\x", None, "")
    assert one.ownEntries == one.allEntries == 10 and one.ownLnks == one.allLnks == len(one.LNKs.LNK)


def test_an_export_is_not_mostly_blanks(spark, tmp_path):
    entries, lnks = records(spark)
    few = [rows.filter("appid = 'a9'") for rows in (entries, lnks)]
    path = str(tmp_path / "export")
    xml.write_documents(documents(*few), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").collect())
    assert "\n" in text and len(text.replace("  ", "")) > 0.95 * len(text)
    assert xml.read_entries(spark, path).count() == 10
