from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from jumptrail.operators.activity import admissible, latest, recent_docs
from jumptrail.streaming.ingest import LNKS, REJECTS, ingested, stream_ingest
from jumptrail.streaming.recents import recents, stream_recents


def container(name: str, n: int) -> str:
    rows = "".join(f'<DestListEntryV2 EntryNumber="{i}" Path="{name}{i}.txt"/>' for i in range(n))
    return f"<AutomaticDestinations><DestList>{rows}</DestList><LNKs><LNK/></LNKs></AutomaticDestinations>"


def test_ingest_restarts_where_it_stopped(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(container("a", 3))
    (tmp_path / "in" / "bad.xml").write_text("<AutomaticDestinations><DestLi")
    stream_ingest(spark, folder, out, checkpoint).awaitTermination()
    (tmp_path / "in" / "b.xml").write_text(container("b", 2))
    for _ in range(2):
        stream_ingest(spark, folder, out, checkpoint, files_per_batch=1).awaitTermination()
    got = sorted((r.appid, r.position, r.path) for r in ingested(spark, out).collect())
    assert got == [("a", i + 1, f"a{i}.txt") for i in range(3)] + [("b", i + 1, f"b{i}.txt") for i in range(2)]
    assert sorted((r.appid, r.position) for r in ingested(spark, out, LNKS).collect()) == [("a", 1), ("b", 1)]
    assert [r.file for r in ingested(spark, out, REJECTS).collect()] == ["bad.xml"]


def test_recents_equal_batch_after_restart_and_repeat(spark, tmp_path):
    schema = "appid string, path string, last_modified timestamp_ntz"
    adds = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 9).cast("string"))).alias("appid"),
        F.concat(F.lit("d"), (F.col("id") % 40).cast("string"), F.when(F.col("id") % 4 > 0, ".TXT").otherwise(".doc")).alias("path"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,(id * 37) % 301, 0)").alias("last_modified"),
    )
    known = adds.filter("path <> 'd1.TXT'").select("path").distinct()
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    halves = adds.withColumn("half", F.monotonically_increasing_id() % 2)
    for half in (0, 1):
        halves.filter(F.col("half") == half).drop("half").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        stream_recents(stream, known, out, checkpoint).awaitTermination()
    want = latest(admissible(adds, known))
    got = recents(spark, out).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 30
    # A batch that runs again under a number already used replaces what it wrote.
    shutil.rmtree(checkpoint)
    stream = spark.readStream.schema(schema).parquet(folder)
    stream_recents(stream, known, out, checkpoint).awaitTermination()
    again = recents(spark, out).select(want.columns)
    assert again.exceptAll(want).count() == 0 and want.exceptAll(again).count() == 0
    top = {(r.appid, r["rank"]) for r in recent_docs(again, 2).collect()}
    assert ("hot", 1) in top and ("hot", 2) in top and ("hot", 3) not in top


def test_folders_grow_with_the_logarithm_of_the_batches(spark, tmp_path, monkeypatch):
    from jumptrail.streaming import recents as module

    def rows(n):
        return spark.createDataFrame([("a", f"d{n % 7}", n)], "appid string, path string, last_modified int").withColumn(
            "last_modified", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,last_modified,0)")
        )

    out = str(tmp_path / "out")
    for n in range(17):
        module.append(spark, rows(n), out)
        folders = module.Manifest(spark, out).folders()
        assert len(folders) <= 7 and [level for level, _ in folders] == sorted((level for level, _ in folders), reverse=True)
    assert [level for level, _ in folders] == [2, 0]
    want = {f"d{n % 7}": n for n in range(17)}
    got = {r.path: r.last_modified.minute for r in recents(spark, out).collect()}
    assert got == want
    # What a crash leaves behind: a folder that no manifest names, and a manifest that was never put in place.
    rows(59).write.parquet(f"{out}/level=0-orphan")
    (tmp_path / "out" / "_manifest" / ".half").write_text("[[0, ")
    assert {r.path: r.last_modified.minute for r in recents(spark, out).collect()} == want
    # A crash between writing and committing: nothing counts until the next batch, which repeats it.
    monkeypatch.setattr(module.Manifest, "commit", lambda self, folders: (_ for _ in ()).throw(OSError("crash")))
    try:
        module.append(spark, rows(30), out)
    except OSError:
        pass
    monkeypatch.undo()
    assert {r.path: r.last_modified.minute for r in recents(spark, out).collect()} == want
    module.append(spark, rows(30), out)
    module.append(spark, rows(30), out)
    assert {r.path: r.last_modified.minute for r in recents(spark, out).collect()} == want | {"d2": 30}
    left = [name for name in (p.name for p in (tmp_path / "out").iterdir()) if name != "_manifest"]
    assert "level=0-orphan" not in left and len(left) <= 8


def test_tables_of_a_batch_are_written_side_by_side_and_noted_last(spark, tmp_path, monkeypatch):
    from threading import Barrier

    from jumptrail.streaming import ingest

    met = Barrier(3, timeout=60)

    def waits(of):
        def step(*args):
            met.wait()
            assert not (tmp_path / "out" / ingest.FILES).exists()
            return of(*args)

        return step

    for name in ("entries_of", "lnks_of", "container_parts"):
        monkeypatch.setattr(ingest, name, waits(getattr(ingest, name)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(container("a", 3))
    stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert ingested(spark, str(tmp_path / "out")).count() == 3 and ingested(spark, str(tmp_path / "out"), LNKS).count() == 1
