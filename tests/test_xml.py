from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jumptrail.operators import documents as docs
from jumptrail.operators import report
from jumptrail.operators.activity import (
    container_counts, sort_by_number, sort_by_text, timeline_gaps, top_entries, with_positions,
)
from jumptrail.sources import containers, xml

FILES = {
    "9b9cdc69c1c24e2b.xml": """<?xml version="1.0"?><AutomaticDestinations><DestList>
      <DestListEntryV2 EntryNumber="2" Path="C:\\a &amp; &lt;b&gt;.txt" LastModified="2024-01-02 03:04:05.5"/>
      <DestListEntryV1 EntryNumber="9" Path="old"/>
      <DestListEntryV2 EntryNumber="1" LastModified="soon"/></DestList>
      <LNKs><LNK><LinkInfo LocalBasePath=" C:\\a "/></LNK><LNK/><LNK><NAME_STRING String="n"/>
      <COMMAND_LINE_ARGUMENTS String="--v"/></LNK></LNKs></AutomaticDestinations>""",
    "nolnk.xml": "<AutomaticDestinations><DestList><DestListEntryV2 EntryNumber='1' Path='p'/></DestList><LNKs/></AutomaticDestinations>",
    "nolist.xml": "<AutomaticDestinations><LNKs><LNK/></LNKs></AutomaticDestinations>",
    "version1.xml": "<AutomaticDestinations><DestList><DestListEntryV1 EntryNumber='1'/></DestList><LNKs><LNK/></LNKs></AutomaticDestinations>",
    "badtype.xml": "<AutomaticDestinations><DestList><DestListEntryV2 EntryNumber='zz' Path='p'/></DestList><LNKs><LNK/></LNKs></AutomaticDestinations>",
    "malformed.xml": "<AutomaticDestinations><DestList><DestListEntryV2 EntryNumber='1'></DestList></AutomaticDestinations>",
    "truncated.xml": "<AutomaticDestinations><DestList><DestListEnt",
    "master.xml": "<autoFiles><autoFile file='9b9cdc69c1c24e2b.xml' appid='9b9cdc69c1c24e2b'/><autoFile file='gone.xml' appid='gone'/></autoFiles>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("export")
    for name, text in FILES.items():
        (path / name).write_text(text)
    return str(path)


def test_entries_of_foreign_export(spark, folder):
    good, _ = docs.split_rejects(xml.read_documents(spark, folder))
    rows = {(r.file, r.position): r for r in docs.entries_of(good).collect()}
    assert set(rows) == {("9b9cdc69c1c24e2b.xml", 1), ("9b9cdc69c1c24e2b.xml", 2), ("nolnk.xml", 1), ("badtype.xml", 1)}
    first = rows["9b9cdc69c1c24e2b.xml", 1]
    assert (first.appid, first.entry_number, first.path) == ("9b9cdc69c1c24e2b", 2, "C:\\a & <b>.txt")
    assert str(first.last_modified) == "2024-01-02 03:04:05.500000"
    second = rows["9b9cdc69c1c24e2b.xml", 2]
    assert (second.path, second.last_modified, second.last_modified_text) == (None, None, "soon")
    assert rows["badtype.xml", 1].entry_number is None


def test_lnk_positions_count_empty_records(spark, folder):
    rows = xml.read_lnks(spark, folder).filter("appid = '9b9cdc69c1c24e2b'").orderBy("position").collect()
    assert [(r.position, r.local_base_path, r.name_string, r.arguments) for r in rows] == [
        (1, " C:\\a ", None, None), (2, None, None, None), (3, None, "n", "--v"),
    ]


def test_rejects_and_eligible(spark, folder):
    good, rejects = docs.split_rejects(xml.read_documents(spark, folder))
    assert {r.file for r in rejects.collect()} == {"malformed.xml", "truncated.xml"}
    assert all(r.raw for r in rejects.collect())
    assert {r.file for r in docs.eligible(good).collect()} == {"9b9cdc69c1c24e2b.xml", "version1.xml", "badtype.xml"}


def test_documents_in_a_column(spark):
    df = spark.createDataFrame(list(FILES.items()), "file string, t string")
    parsed = docs.parse_documents(df, "t")
    _, rejects = docs.split_rejects(parsed)
    assert {"malformed.xml", "truncated.xml"} == {r.file for r in rejects.collect()}


def test_orders_of_entries_as_read(spark, folder):
    entries = xml.read_entries(spark, folder)
    by_number = {(r.file, r.position): r["rank"] for r in sort_by_number(entries).collect()}
    assert by_number["9b9cdc69c1c24e2b.xml", 1] == 2 and by_number["9b9cdc69c1c24e2b.xml", 2] == 1
    by_path = {(r.file, r.position): r["rank"] for r in sort_by_text(entries, "path", False).collect()}
    assert by_path["9b9cdc69c1c24e2b.xml", 1] == 1 and by_path["9b9cdc69c1c24e2b.xml", 2] == 2
    whole = {(r.file, r.position): r["rank"] for r in sort_by_text(entries, "path", keys=()).collect()}
    assert sorted(whole.values()) == [1, 2, 3, 4] and whole["9b9cdc69c1c24e2b.xml", 2] == 1
    assert [r.path for r in top_entries(entries, 1).collect()] == ["C:\\a & <b>.txt"]
    assert timeline_gaps(entries).filter("prev IS NOT NULL").count() == 0


def test_union_of_hosts_and_counts(spark, folder):
    one, two = (xml.read_entries(spark, folder).withColumn("host", F.lit(h)) for h in "AB")
    both = docs.union_hosts(one, two)
    counts = container_counts(both, xml.read_lnks(spark, folder).withColumn("host", F.lit("A")))
    got = {(r.host, r.appid): (r.n_entries, r.n_lnks) for r in counts.collect()}
    assert got["A", "9b9cdc69c1c24e2b"] == (2, 3) and got["B", "9b9cdc69c1c24e2b"] == (2, 0)
    assert got["A", "nolist"] == (0, 1) and got["A", "nolnk"] == (1, 0)


def test_index_and_report(spark, folder):
    index = xml.read_index(spark, folder + "/master.xml")
    rows = report.report_rows(index, xml.read_entries(spark, folder), xml.read_lnks(spark, folder))
    got = {(r.section, r.position): (r.file, r.c1, r.c2, r.c3, r.c4) for r in rows.collect()}
    name = "9b9cdc69c1c24e2b.xml"
    assert set(got) == {("DestList", 1), ("DestList", 2), ("LNKs", 1), ("LNKs", 2), ("LNKs", 3)}
    assert got["LNKs", 3] == (name, "3", None, "n", "--v") and got["LNKs", 2] == (name, "2", None, None, None)
    lines = report.report_html(rows)
    html = {(r.file, r.section, r.part, r.position): r.html for r in lines.collect()}
    assert html[name, "DestList", 1, 1].startswith("<tr><td>2</td><td>C:\\a &amp; &lt;b&gt;.txt</td><td>2024")
    assert html[name, "LNKs", 2, 0] == "</table>" and len(html) == 5 + 4
    assert html[name, "DestList", 0, 0].startswith(f'<h2>{name}</h2><h2>DestList</h2><table border="1" id="_t{name[:-4]}">')


def test_report_shows_last_modified_as_it_is_written(spark, folder):
    index = xml.read_index(spark, folder + "/master.xml")
    rows = report.report_rows(index, xml.read_entries(spark, folder), xml.read_lnks(spark, folder))
    shown = {r.position: r.c3 for r in rows.filter("section = 'DestList'").collect()}
    assert shown == {1: "2024-01-02 03:04:05.5", 2: "soon"}


def test_written_report_reads_in_order(spark, tmp_path):
    rows = spark.range(500).select(
        F.lit("H").alias("host"), F.lit("a.xml").alias("file"), F.lit("a").alias("appid"), F.lit("DestList").alias("section"),
        (F.col("id") + 1).alias("position"), F.col("id").cast("string").alias("c1"),
        *(F.lit(None).cast("string").alias(f"c{i}") for i in (2, 3, 4)),
    )
    report.write_report(report.report_html(rows.repartition(7)), str(tmp_path / "r"))
    parts = sorted((tmp_path / "r" / "host=H" / "appid=a").glob("*.txt"))
    lines = "".join(part.read_text() for part in parts).splitlines()
    assert lines[0].startswith("<h2>a.xml</h2><h2>DestList</h2>") and lines[501] == "</table>" and lines[502].startswith("<h2>LNKs</h2>")
    assert lines[1:501] == [f"<tr><td>{i}</td><td></td><td></td></tr>" for i in range(500)]


@pytest.mark.parametrize("per_container", [False, True])
def test_long_container_comes_back_whole(spark, tmp_path, per_container):
    entries = with_positions(
        spark.range(2500).select(
            F.lit("H").alias("host"), F.when(F.col("id") % 50 > 0, "big").otherwise("small").alias("appid"),
            F.col("id").alias("event_id"), F.col("id").alias("entry_number"),
            F.concat(F.lit("p \t<&>\"' żó😀"), F.col("id").cast("string")).alias("path"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00.25' + make_interval(0,0,0,0,0,0,id)").alias("last_modified"),
        )
    )
    lnks = entries.filter("appid = 'big'").select(
        "host", "appid", "position", F.lit(None).cast("string").alias("local_base_path"),
        F.when(F.col("position") % 3 == 0, "n").alias("name_string"), F.lit(None).cast("string").alias("arguments"),
    )
    made = docs.documents(entries, lnks)
    largest = made.select(F.max(F.size("DestList.DestListEntryV2")), F.max(F.size("LNKs.LNK"))).first()
    assert max(largest) <= docs.DOCUMENT_RECORDS and made.count() > 2
    path = str(tmp_path / "x")
    xml.write_documents(made, path, per_container)
    back = xml.read_entries(spark, path)
    columns = ["host", "appid", "position", "entry_number", "path", "last_modified"]
    assert back.select(columns).exceptAll(entries.select(columns)).count() == 0 and back.count() == 2500
    found = xml.read_lnks(spark, path)
    columns = ["host", "appid", "position", "local_base_path", "name_string", "arguments"]
    assert found.select(columns).exceptAll(lnks.select(columns)).count() == 0 and found.count() == lnks.count()
    assert [(r.host, r.appid, r.file) for r in docs.eligible(xml.read_documents(spark, path)).collect()] == [("H", "big", "big.xml")]
    if per_container:
        listed = containers.scan_export(spark, path).select("host", "appid").distinct()
        assert {tuple(r) for r in listed.collect()} == {("H", "big"), ("H", "small")}


def test_inventory_of_container_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("ab12.automaticDestinations-ms", "note.txt", "sub/cd34.automaticDestinations-ms"):
        (tmp_path / name).write_bytes(b"12345")
    found = containers.scan_containers(spark, str(tmp_path))
    assert [(r.file, r.appid, r.length) for r in found.collect()] == [("ab12.automaticDestinations-ms", "ab12", 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<modificationTime:timestamp,length:bigint>" in plan.replace("path:string,", "")


def test_characters_xml_cannot_hold(spark, tmp_path):
    entries = spark.createDataFrame(
        [("H", "a", 1, 1, "x\x01y"), ("H", "a", 2, 2, "ok"), ("H", "b", 1, 1, "fine \t\n\r é日😀"), ("H", "c", 1, 1, None)],
        "host string, appid string, position bigint, entry_number bigint, path string",
    ).withColumn("last_modified", F.lit(None).cast("timestamp_ntz"))
    lnks = spark.createDataFrame(
        [("H", "c", 1, None, "\uffff", None), ("H", "b", 1, "p", None, None), ("H", "a", 1, "p", None, None)],
        "host string, appid string, position bigint, local_base_path string, name_string string, arguments string",
    )
    good, rejects = docs.split_unwritable(docs.documents(entries, lnks))
    path = str(tmp_path / "x")
    xml.write_documents(good, path)
    assert [(r.appid, r.path) for r in xml.read_entries(spark, path).collect()] == [("b", "fine \t\n\r é日😀")]
    assert [r.appid for r in xml.read_lnks(spark, path).collect()] == ["b"]
    assert sorted((r.host, r.file) for r in rejects.collect()) == [("H", "a.xml"), ("H", "c.xml")]


def test_a_broken_document_costs_only_itself(spark, tmp_path):
    def one(name, body="<DestList><DestListEntryV2 EntryNumber='1' Path='p'/></DestList><LNKs><LNK/></LNKs>", end="</AutomaticDestinations>"):
        return f'<AutomaticDestinations host="H" appid="{name}" first="0">{body}{end}'

    cut = one("cut", end="")
    open_ = one("open", "<DestList><DestListEntryV2")
    quoted = one("quoted", "<DestList><DestListEntryV2 Path='x/></DestList>")
    parts = [one("a"), cut, one("b"), open_, one("c"), quoted, one("d"), "<AutomaticDestinations appid='none'/>", one("e", end="")]
    (tmp_path / "many.xml").write_text("<?xml version='1.0'?>\n<jumpLists>\n" + "\n".join(parts))
    good, rejects = docs.split_rejects(xml.read_documents(spark, str(tmp_path)))
    assert sorted(r.appid for r in good.collect()) == ["a", "b", "c", "d", "none"]
    found = {r.appid: (r.host, r.first, r.raw.strip()) for r in rejects.collect()}
    assert found == {name: ("H", 0, text) for name, text in (("cut", cut), ("open", open_), ("quoted", quoted), ("e", parts[-1]))}
    assert sorted(r.appid for r in xml.read_entries(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d"]


def test_host_of_foreign_exports(spark, tmp_path):
    entry = "<AutomaticDestinations><DestList><DestListEntryV2 EntryNumber='1'/></DestList></AutomaticDestinations>"
    lnk = "<AutomaticDestinations><LNKs><LNK/></LNKs></AutomaticDestinations>"
    for host, text in (("A", entry), ("HO%3AST%251", lnk)):
        (tmp_path / f"host={host}").mkdir()
        (tmp_path / f"host={host}" / "x1.xml").write_text(text)
    found = xml.read_documents(spark, str(tmp_path))
    assert sorted((r.host, r.appid) for r in found.collect()) == [("A", "x1"), ("HO:ST%1", "x1")]
    assert docs.eligible(found).collect() == []
    named = xml.read_documents(spark, str(tmp_path / "host=A" / "x1.xml"), host="given")
    assert [r.host for r in named.collect()] == ["given"]
