"""Every file is accounted for, containers are whole or rejected, rewritten files replace themselves, exports open."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from jumptrail.operators import documents as docs
from jumptrail.operators import report
from jumptrail.sources import cutting, export, files, named, store, xml
from jumptrail.streaming import ingest

ENTRY = '<DestListEntryV2 EntryNumber="{}" Path="{}"/>'


def container(*paths: str, head: str = "", lnks: int = 1) -> str:
    rows = "".join(ENTRY.format(i, path) for i, path in enumerate(paths, 1))
    return f"{head}<AutomaticDestinations><DestList>{rows}</DestList><LNKs>{'<LNK/>' * lnks}</LNKs></AutomaticDestinations>"


def declared(encoding: str) -> str:
    return f'<?xml version="1.0" encoding="{encoding}"?>'


ODD = {
    "good.xml": container("a").encode(),
    "bom.xml": b"\xef\xbb\xbf" + container("é").encode(),
    "u16.xml": container("Zażółć", head=declared("utf-16")).encode("utf-16"),
    "u16be.xml": container("日本", head=declared("UTF-16")).encode("utf-16-be"),
    "u32.xml": container("😀").encode("utf-32"),
    "latin.xml": container("Größe", head=declared("ISO-8859-1")).encode("latin-1"),
    "cp1250.xml": container("Zażółć", head=declared("windows-1250")).encode("cp1250"),
    "lies.xml": container("plain", head=declared("UTF-16")).encode(),
    "zeros.xml": bytes(500),
    "empty.xml": b"",
    "cut.xml": b"<?xml version='1.0'?><AutomaticDest",
    "cut16.xml": container("x").encode("utf-16")[:-7],
    "badutf8.xml": container("caf\xe9").encode("latin-1"),
    "unknown.xml": container("x", head=declared("x-klingon")).encode(),
    "other.xml": b"<?xml version='1.0'?><report><row/></report>",
    "master.xml": b"<?xml version='1.0'?>\n<autoFiles><autoFile file='good.xml' appid='good'/></autoFiles>",
    "name with [x] %20+é.xml": container("n").encode(),
    "many.xml": (container("p") + "junk" + container("q") + "<AutomaticDestinations<DestList/>").encode(),
}
READ = {
    "good": "a", "bom": "é", "u16": "Zażółć", "u16be": "日本", "u32": "😀", "latin": "Größe", "cp1250": "Zażółć", "lies": "plain",
    "name with [x] %20+é": "n",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name, content in ODD.items():
        (folder / name).write_bytes(content)
    return str(folder)


def test_every_file_gives_a_document_or_a_reject(spark, odd):
    entries = {r.appid: r.path for r in xml.read_entries(spark, odd).filter("appid <> 'many'").collect()}
    assert entries == READ
    good, rejects = docs.split_rejects(xml.read_documents(spark, odd))
    reasons = {}
    for row in rejects.collect():
        reasons.setdefault(row.file, []).append(row.reason)
    assert {name: sorted(found) for name, found in reasons.items()} == {
        "zeros.xml": ["no document"], "empty.xml": ["empty file"], "cut.xml": ["no document"],
        "cut16.xml": ["cannot be read as UTF-16LE"], "badutf8.xml": ["cannot be read as UTF-8"],
        "unknown.xml": ["cannot be read as X-KLINGON"], "other.xml": ["no document"],
        "many.xml": ["outside any document", "outside any document"],
    }
    names = {r.file for r in good.collect()} | set(reasons)
    assert names == set(ODD) - {"master.xml"}


def test_accounts_hold_the_listing_against_what_was_read(spark, odd):
    found = {r.file: r for r in xml.account(spark, odd).collect()}
    assert len(found) == len(ODD)
    assert found["empty.xml"].length == 0 and found["empty.xml"].reasons == ["empty file"]
    assert (found["master.xml"].n_documents, found["master.xml"].n_rejects, found["master.xml"].reasons) == (0, 0, [])
    assert (found["many.xml"].n_documents, found["many.xml"].n_rejects, found["many.xml"].n_entries) == (2, 2, 2)
    assert all(r.n_documents + r.n_rejects > 0 for name, r in found.items() if name != "master.xml")


def test_long_files_are_read_in_pieces_and_accounted_for_too(spark, odd, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 10)
    entries = {r.appid: r.path for r in xml.read_entries(spark, odd).filter("appid <> 'many'").collect()}
    utf8 = {name: path for name, path in READ.items() if name in ("good", "bom", "lies", "name with [x] %20+é")}
    assert {name: path for name, path in entries.items() if name in utf8} == utf8
    good, rejects = docs.split_rejects(xml.read_documents(spark, odd))
    read = {r.file for r in good.collect()} | {r.file for r in rejects.collect()}
    assert read >= set(ODD) - {"master.xml", "other.xml", "cut.xml"}


def test_a_container_is_whole_or_wholly_rejected(spark, tmp_path):
    def part(host, appid, first, n, total=None, own=None):
        told = f' allEntries="{total}" allLnks="1"' if total is not None else ""
        rows = "".join(ENTRY.format(first + i + 1, "p") for i in range(n))
        lnk = "<LNKs><LNK/></LNKs>" if first == 0 else ""
        return (
            f'<AutomaticDestinations host="{host}" appid="{appid}" first="{first}" ownEntries="{n if own is None else own}" '
            f'ownLnks="{int(first == 0)}"{told}><DestList>{rows}</DestList>{lnk}</AutomaticDestinations>'
        )

    parts = [
        part("H", "whole", 0, 2, 3), part("H", "whole", 2, 1),
        part("H", "half", 0, 2, 4), part("H", "half", 2, 2)[:-9],
        part("H", "gap", 0, 2, 5), part("H", "gap", 4, 1),
        part("H", "headless", 2, 2),
        part("H", "short", 0, 1, 2, own=2),
        part("I", "half", 0, 1, 1),
        '<AutomaticDestinations host="H" appid="plain"><DestList/><LNKs><LNK/></LNKs></AutomaticDestinations>',
    ]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "all.xml").write_text("<jumpLists>" + "\n".join(parts) + "</jumpLists>")
    read = xml.read_documents(spark, str(tmp_path / "x"))
    whole, left = docs.split_incomplete(read)
    assert {(r.host, r.appid, r.first) for r in whole.collect()} == {("H", "whole", 0), ("H", "whole", 2), ("I", "half", 0), ("H", "plain", 0)}
    rows = {(r.host, r.appid, r.first): r for r in left.collect()}
    assert set(rows) == {("H", "half", 0), ("H", "half", 2), ("H", "gap", 0), ("H", "gap", 4), ("H", "headless", 2), ("H", "short", 0)}
    assert rows["H", "half", 2].reason == "broken document" and rows["H", "half", 0].reason == "part of an incomplete container"
    assert rows["H", "gap", 0].raw == parts[4] and all(r.raw for r in rows.values())
    assert {(r.host, r.appid) for r in docs.eligible(read).collect()} == {("H", "whole"), ("I", "half"), ("H", "plain")}


def names(spark, out, table=ingest.ENTRIES):
    return sorted((r.appid, r.path if table == ingest.ENTRIES else r.reason) for r in ingest.ingested(spark, out, table).collect())


def test_rewritten_touched_and_removed_files(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        ingest.stream_ingest(spark, str(folder), out, checkpoint, files_per_batch=3).awaitTermination()

    for name in "abcd":
        (folder / f"{name}.xml").write_text(container(name + "1", name + "2"))
    (folder / "e.xml").write_bytes(b"")
    run()
    assert names(spark, out) == [(name, name + i) for name in "abcd" for i in "12"]
    assert names(spark, out, ingest.REJECTS) == [("e", "empty file")]
    held = {r.path: r.digest for r in ingest.files_read(spark, out).collect()}
    before = len(os.listdir(f"{out}/{ingest.ENTRIES}"))
    run()
    assert len(os.listdir(f"{out}/{ingest.ENTRIES}")) == before  # nothing changed, nothing written
    (folder / "a.xml").write_text(container("new", lnks=0))
    os.utime(folder / "b.xml", (1, 1))
    (folder / "c.xml").unlink()
    (folder / "d.xml").write_text("<AutomaticDestinations><Dest")
    (folder / "e.xml").write_text(container("e1"))
    run()
    assert names(spark, out) == [("a", "new"), ("b", "b1"), ("b", "b2"), ("e", "e1")]
    assert names(spark, out, ingest.REJECTS) == [("d", "broken document")]
    batch = {(r.appid, r.path) for r in xml.read_entries(spark, str(folder)).collect()}
    assert set(names(spark, out)) == batch
    now = {os.path.basename(r.path): r for r in ingest.files_read(spark, out).collect()}
    assert set(now) == {"a.xml", "b.xml", "d.xml", "e.xml"} and now["b.xml"].digest in held.values()
    # The touched file kept its rows where they were.
    held_by = spark.read.parquet(f"{out}/{ingest.FILES}").filter("path LIKE '%/b.xml'").select("held").distinct().collect()
    assert len(held_by) == 1
    eligible = {r.appid: r.eligible for r in ingest.ingested_containers(spark, out).collect()}
    assert eligible == {"a": False, "b": True, "d": False, "e": True}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.xml").write_text(container("1"))
    ingest.stream_ingest(spark, str(folder), out, str(tmp_path / "one")).awaitTermination()
    # A checkpoint that was lost before the batch was noted in it: the same batches run again.
    ingest.stream_ingest(spark, str(folder), out, str(tmp_path / "two")).awaitTermination()
    assert names(spark, out) == [("a", "1")]


def stored(spark, folder):
    return store.store_export(spark, folder, "H", buckets=4)


@pytest.fixture(scope="module")
def some(tmp_path_factory):
    folder = tmp_path_factory.mktemp("some")
    for name, paths in (("b", ["1 & <2>", "\t\n\"'"]), ("a", ["x"]), ("nolnk", ["y"])):
        lines = [path.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;") for path in paths]
        (folder / f"{name}.xml").write_text(container(*lines, lnks=0 if name == "nolnk" else 2))
    (folder / "bad.xml").write_text("<AutomaticDestinations><DestLi")
    return str(folder)


def test_exported_files_open_in_the_order_of_the_index(spark, some, tmp_path):
    kept = stored(spark, some)
    path = str(tmp_path / "out")
    export.export_containers(spark, kept, path)
    assert sorted(os.listdir(path)) == ["host=H"] and sorted(os.listdir(f"{path}/host=H")) == ["a.xml", "b.xml", "master.xml"]
    assert [tuple(r) for r in export.read_master(spark, path).orderBy("place").collect()] == [("H", 1, "a.xml", "a"), ("H", 2, "b.xml", "b")]
    want = {(r.appid, r.position, r.path) for r in xml.read_entries(spark, some).filter("appid <> 'nolnk'").collect()}
    back = xml.read_entries(spark, path)
    assert {(r.appid, r.position, r.path) for r in back.collect()} == want and {r.host for r in back.collect()} == {"H"}
    with open(f"{path}/host=H/a.xml") as text:
        assert text.read().startswith('<?xml version="1.0" encoding="utf-8"?>\n<AutomaticDestinations>\n  <DestList>\n')
    left = spark.read.parquet(kept.rejects).select("file").collect()
    assert [r.file for r in left] == ["bad.xml"]
    store.release(spark, kept)


def test_report_of_all_containers_follows_the_index(spark, some, tmp_path):
    kept = stored(spark, some)
    lines = report.report_html(report.document_rows(store.listed_documents(spark, kept)), store.stored_index(spark, kept))
    report.write_report(lines, str(tmp_path / "report"))
    text = "".join(open(path).read() for path in sorted((tmp_path / "report").glob("part-*")))
    assert re.findall("<h2>(.*?)</h2>", text) == ["a.xml", "DestList", "LNKs", "b.xml", "DestList", "LNKs"]


def test_index_entries_and_links_meet_without_a_shuffle(spark, some, monkeypatch):
    kept = stored(spark, some)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = report.report_html(report.document_rows(store.listed_documents(spark, kept)), store.stored_index(spark, kept))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Format: Text" not in plan and "binaryFile" not in plan
    assert found.count() == 4 * 2 + 3 + 4


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(20).select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") < 15, F.lit("x")).otherwise(F.raise_error(F.lit("no"))).cast("binary").alias("content"),
    )
    with pytest.raises(Exception, match="no"):
        named.write_named(rows.repartitionByRange(5, "name"), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    again = rows.filter("id < 15").repartition(3, "name")
    named.write_named(again, path)
    assert sorted(os.listdir(path)) == sorted(f"n{i}" for i in range(15))


def test_times_and_lengths_key_what_is_kept(spark, tmp_path):
    from jumptrail.plans import fixtures as fx

    made = []
    for name in set(fx.BASE.values()):
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _ in range(2):
        fx.once(spark, str(tmp_path), "thing", lambda: made.append(1))
    spark.range(30).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    fx.once(spark, str(tmp_path), "thing", lambda: made.append(1))
    assert len(made) == 2


def listing(rows):
    return sorted((r.path, r.location, r.length, r.modified) for r in rows.collect())


def test_tasks_list_what_the_file_source_lists(spark, odd, tmp_path):
    for name, content in ODD.items():
        for folder in ("host=a", "host=b%2Fc d/appid=é", "_left", ".out", "_k=1"):
            (tmp_path / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "none").mkdir()
    here = str(tmp_path)
    want = listing(files.listed_by_source(spark, here))
    assert len(want) == 3 * len(ODD) and listing(files.listed(spark, here)) == want
    assert listing(files.listed(spark, f"file://{here}/host=*")) == listing(files.listed_by_source(spark, f"file://{here}/host=*"))
    some = [location for _, location, _, _ in want[:7]]
    assert listing(files.listed(spark, some)) == want[:7]
    assert files.listed(spark, f"{here}/none").isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listed(spark, f"{here}/gone")


def test_the_driver_holds_no_list_of_the_files(spark, odd, tmp_path):
    for found in (xml.account(spark, odd), xml.read_entries(spark, odd), export.read_master(spark, odd)):
        plan = found._jdf.queryExecution().toString()
        assert "binaryFile" not in plan and odd not in plan
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.xml").write_text(container("1"))
    ingest.note_changes(spark, str(folder), f"{out}/{ingest.CHANGES}")
    assert spark.read.parquet(f"{out}/{ingest.CHANGES}").count() == 1


def test_a_file_that_went_away_is_an_error_or_left_out(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.xml").write_text(container(name))
    found = files.listed(spark, str(tmp_path))
    (tmp_path / "a.xml").unlink()
    left = files.whole_files(spark, found, skip_gone=True).collect()
    assert [r.name for r in left] == ["b.xml"]
    with pytest.raises(Exception, match="a.xml"):
        files.whole_files(spark, found).collect()


def test_a_store_that_tasks_cannot_open_is_read_by_the_file_source(spark, odd, monkeypatch):
    want = sorted(map(str, xml.account(spark, odd).collect()))
    monkeypatch.setattr(files, "_opens", lambda location: False)
    assert sorted(map(str, xml.account(spark, odd).collect())) == want


def long_one(host: str, n: int, head: str = "", told: str = "") -> str:
    """A container that is long where texts are cut after a few hundred characters, with what makes it hard to cut."""
    rows = "".join(f'<DestListEntryV2 EntryNumber="{i}" Path="Größe > {i}"/>' + "<DestListEntryV1/>" * (i % 2) for i in range(n))
    links = "".join(f"<LNK><LinkInfo LocalBasePath='/&gt;{i}'/></LNK>" if i % 3 else "<LNK/> " for i in range(n + 7))
    other = "<Other><LNK/>" + "<x>y</x>" * 50 + "</Other><!-- <DestList> -->"
    return f'{head}<AutomaticDestinations host="{host}"{told}>\n<DestList><DestListEntryV2 Path="old"/></DestList>{other}<DestList>{rows}</DestList><LNKs>{links}</LNKs></AutomaticDestinations>'


def long_files():
    one = long_one("H", 40)
    yield "plain.xml", one.encode()
    yield "u16.xml", long_one("H", 40, declared("UTF-16")).encode("utf-16")
    yield "latin.xml", long_one("H", 40, declared("ISO-8859-1")).encode("latin-1")
    yield "told.xml", long_one("H", 40, told=" ownEntries='40' ownLnks='47' allEntries='40' allLnks='47'").encode()
    yield "short.xml", long_one("H", 40, told=" ownEntries='41' ownLnks='47'").encode()
    yield "cut.xml", one[:-100].encode()
    yield "broken.xml", one.replace("<LNK/> ", "<LNK>").encode()
    yield "unbound.xml", one.replace("y</x>", "<p:y/></x>", 1).encode()
    yield "many.xml", ("<!-- " + "x" * 900 + " -->" + one + "junk" * 200 + one + "  </jumpLists> <!-- " + "y" * 700 + "-->" + one[:-30]).encode()
    yield "bad.xml", (one + one).replace("Größe > 7", "Gr\xff", 1).encode("latin-1")
    yield "cut16.xml", one.encode("utf-16")[:-7]
    yield "zeros.xml", bytes(5000)
    yield "blank.xml", b" " * 5000


def test_what_a_file_gives_does_not_depend_on_its_length(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in long_files():
        (folder / name).write_bytes(content)

    def found():
        accounts = sorted(map(str, xml.account(spark, str(folder)).collect()))
        read = xml.read_documents(spark, str(folder))
        entries = sorted((r.file, r.position, r.path) for r in docs.entries_of(docs.split_rejects(read)[0]).collect())
        links = sorted((r.file, r.position, str(r.local_base_path)) for r in xml.read_lnks(spark, str(folder)).collect())
        eligible = sorted(map(str, docs.eligible(read.filter("file <> 'many.xml'")).collect()))
        rejects = {(r.host, r.file, r.reason) for r in docs.split_rejects(read)[1].collect()}
        kept = store.store_export(spark, str(folder), buckets=4)
        report_rows = sorted(map(str, report.document_rows(store.listed_documents(spark, kept).filter("file <> 'many.xml'").drop("place")).collect()))
        path = str(tmp_path / f"out{cutting.LONG}")
        export.export_containers(spark, kept, path)
        texts = {name: (tmp_path / path / "host=H" / name).read_text().split() for name in ("plain.xml", "u16.xml", "told.xml")}
        store.release(spark, kept)
        return accounts, entries, links, eligible, rejects, report_rows, texts

    want = found()
    assert [(f, p) for f, p, path in want[1] if f == "u16.xml"] == [("u16.xml", i) for i in range(1, 41)] and len(want[2]) > 4 * 47
    assert "reasons=['cannot be read as UTF-16LE']" in "".join(a for a in want[0] if "cut16.xml" in a) and len(want[3]) == 5
    monkeypatch.setattr(files, "WHOLE", 10)
    monkeypatch.setattr(cutting, "BLOCK", 61)
    monkeypatch.setattr(cutting, "LONG", 600)
    got = found()
    for one, other in zip(got, want):
        assert one == other


def test_a_long_index_is_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "host=H").mkdir()
    lines = "".join(f'  <autoFile file="f{i} &amp;&#9;x.xml" appid="f{i}"/>\n' for i in range(60))
    (tmp_path / "host=H" / "master.xml").write_text(f"{export.HEAD}<autoFiles>\n{lines}</autoFiles>\n")
    (tmp_path / "host=I").mkdir()
    (tmp_path / "host=I" / "master.xml").write_text(f"{export.HEAD}<autoFiles>\n{lines}")

    def rows():
        return sorted(map(tuple, export.read_master(spark, str(tmp_path)).collect()))

    want = rows()
    assert [(r[0], r[1], r[3]) for r in want] == [("H", i + 1, f"f{i}") for i in range(60)]
    monkeypatch.setattr(files, "WHOLE", 10)
    monkeypatch.setattr(cutting, "BLOCK", 61)
    monkeypatch.setattr(cutting, "LONG", 300)
    assert rows() == want
    assert files.whole_files(spark, str(tmp_path), cut=cutting.index_entries).count() > 5
