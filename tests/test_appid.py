from __future__ import annotations

import random

import plain
import pytest
from pyspark.sql import functions as F

from jumptrail.functions.crc64 import crc64
from jumptrail.functions.registry import register_functions
from jumptrail.functions.text import appid_hex, file_stem, upper_invariant
from jumptrail.known_folders import FOLDER_PATHS, ROWS, known_folders, known_guids
from jumptrail.operators import appid

GOLDENS = {
    "{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\notepad.exe": "9B9CDC69C1C24E2B",
    "{D65231B0-B2F1-4857-A4CE-A8E7C6EA7D27}\\notepad.exe": "918E0ECB43D17E23",
    "{F38BF404-1D43-42F2-9305-67DE0B28FC23}\\explorer.exe": "1B4DD67F29CB1962",
    "Microsoft.Windows.Explorer": "F01B4D95CF55D32A",
    "{905E63B6-C1BF-494E-B29C-65B732D3D21A}\\APP\\tool.exe": "25BA249A56F5C556",
    "{6D809377-6AF0-444b-8957-A3773F02200E}\\APP\\tool.exe": "46A2C5E7E711E9E",
    "Zażółć": "FED0AC9B3DF004C",
    "日本": "9AF3561A35547007",
    "Straße": "3CE6C4212FEB026C",
    "": "FFFFFFFFFFFFFFFF",
}

# path, class, env form, AppIDs by variant
EXPECTED = [
    (r"C:\Windows\System32\small_ring.exe", "system", r"%WINDIR%\SYSTEM32", {"1": "9EDA95830A22502B", "2/x86": "E2A1F98012F35E32"}),
    (r"C:\Windows\SysWOW64\ECONOMY\red_widget.exe", "system", r"%WINDIR%\SYSWOW64\ECONOMY", {"1": "DD7A1754A3A40E26", "2/x86": "A1017B57BB75003F"}),
    (r"c:\windows\blue_bolt.exe", "windows", "%WINDIR%", {"1": "96CC5F63C1E2E5A"}),
    (r"C:\Windows\ECONOMY\hot_gear.exe", "windows", r"%WINDIR%\ECONOMY", {"1": "6298A6C7850558A0"}),
    (r"C:\Program Files\Brand#25\small_gizmo.exe", "program_files", r"%PROGRAMFILES%\BRAND#25", {"1": "910D77A147C6D263", "2/X64": "7F55CBE7CAAD5A1E", "3/x86": "2B4D10A7D95273F"}),
    (r"C:\Program Files (x86)\Brand#12\small_bolt.exe", "program_files", r"%PROGRAMFILES%\BRAND#12", {"1": "F623E9617C24B44", "2/X64": "24EC6BC896BFD1D9", "3/x86": "794DE6DACBB017DD"}),
    (r"C:\Program Files\Common Files\Brand#17\old_bolt.exe", "common_files", r"%PROGRAMFILES%\COMMON FILES\BRAND#17", {"1": "76817FDEA81D1D4E", "2/X64": "D7AAAD16BC265E7C", "3/x86": "315EFDEA03C651AA"}),
    (r"C:\Program Files\red_bolt.exe", "unresolved", "%PROGRAMFILES%", {}),
    (r"{6D809377-6AF0-444b-8957-A3773F02200E}\Brand#3\large_plate.exe", "unresolved", r"{6D809377-6AF0-444B-8957-A3773F02200E}\BRAND#3", {}),
    (r"{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}\Brand#2\blue_gear.exe", "known_guid", r"{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}\BRAND#2", {"": "9F797655A177C8D"}),
    (r"C:\Users\bob\AppData\Roaming\large_anvil.exe", "unresolved", "%APPDATA%", {}),
    ("Vendor.Brand#1.small_anvil.exe", "explicit", None, {"": "F7FC77FE0F74DB97"}),
    (r"C:\Program Files\Common Files\x.exe", "program_files", r"%PROGRAMFILES%\COMMON FILES", {"1": "1CF6EB55DE5F6FBB", "2/X64": "CA2129C5C18076A7", "3/x86": "54D6B30BB0B12F70"}),
    (r"C:\WindowsApps\x.exe", "unresolved", "%WINDIR%APPS", {}),
    (r"C:\Users\public\x.exe", "unresolved", "%USERPROFILE%UBLIC", {}),
    (r"C:\Users\bob\Desktop\x.exe", "unresolved", r"%USERPROFILE%OB\DESKTOP", {}),
    (r"C:\Users\bob\AppData\LocalLow\x.exe", "unresolved", "%LOCALAPPDATA%LOW", {}),
    (r"\x.exe", "explicit", None, {"": "3788C676DA9AB4BF"}),
    ("C:\\x\\", "explicit", None, {"": "6C12859BB03F6385"}),
    (r"D:\tools\x.exe", "unresolved", r"D:\TOOLS", {}),
    (r"C:\ProgramData\v\x.exe", "unresolved", r"%ALLUSERSPROFILE%\V", {}),
    ("C:\\a\nb\\x.exe", "explicit", None, {"": plain.appid("C:\\a\nb\\x.exe")}),
    ("C:\\Windows\\a\rb\\x\ny.exe", "windows", "%WINDIR%\\A\rB", {"1": plain.appid("{F38BF404-1D43-42F2-9305-67DE0B28FC23}\\A\rB\\x\ny.exe")}),
    (r"C:\Windows\Straße\x.exe", "windows", "%WINDIR%\\STRAßE", {"1": plain.appid("{F38BF404-1D43-42F2-9305-67DE0B28FC23}\\Straße\\x.exe")}),
    ("", "invalid", None, {}),
    (None, "invalid", None, {}),
]


@pytest.fixture(scope="module")
def expected_paths(spark):
    rows = [(i, path) for i, (path, *_) in enumerate(EXPECTED)]
    return spark.createDataFrame(rows, "path_id bigint, path string")


def test_goldens(spark):
    rows = [(text, want) for text, want in GOLDENS.items()]
    df = spark.createDataFrame(rows, "text string, want string")
    got = df.select("text", "want", appid_hex(crc64("text")).alias("got")).collect()
    assert {row.text: row.got for row in got} == GOLDENS
    assert {text: plain.appid(text) for text in GOLDENS} == GOLDENS


def test_class_and_env_form(expected_paths):
    rows = appid.classified(expected_paths).orderBy("path_id").collect()
    assert [(r.path, r["class"], r.env_dir) for r in rows] == [(p, c, e) for p, c, e, _ in EXPECTED]


def test_candidates_of_every_class(expected_paths):
    got = {}
    for row in appid.appids(expected_paths).collect():
        got.setdefault(row.path_id, {})[row.variant] = row.appid
    assert got == {i: ids for i, (*_, ids) in enumerate(EXPECTED) if ids}


def test_env_and_guid_paths(spark):
    df = spark.createDataFrame(
        [(1, r"C:\Windows\System32\wbem\x.exe"), (2, r"C:\Program Files\Common Files\a\x.exe"), (3, "App.Id")],
        "path_id int, path string",
    )
    rows = {(r.path_id, r.variant): (r.env_path, r.guid_path) for r in appid.candidates(df).collect()}
    assert rows[1, "1"] == (r"%windir%\system32\x.exe", r"{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\x.exe")
    assert rows[2, "2/X64"] == (
        r"%ProgramFiles%\Common Files\A\x.exe",
        r"{6365D5A7-0F0D-45E5-87F6-0DA56B6A4F7D}\A\x.exe",
    )
    assert rows[3, ""] == ("App.Id", "App.Id")


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    alphabets = ["abcXYZ019 \\.:{}%", "abżółćßıſµÿŉǰ", "日本語かな", "a😀𐐨𝒳é", "ab\x00\x1f\n\r"]
    texts = ["", "a" * 70_000, "ż" * 5_000, "😀" * 300]
    for _ in range(n):
        letters = rng.choice(alphabets)
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(60))))
    return texts


def test_checksum_of_random_texts(spark):
    texts = random_texts(3000) + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    got = {r.id: r.bits for r in df.select("id", crc64("text").alias("bits")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
        else:
            assert got[i] % (1 << 64) == plain.crc64(text), text[:80]


def test_invariant_upper(spark):
    texts = random_texts(500)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("text", upper_invariant("text").alias("got")).collect()
    assert all(row.got == plain.upper(row.text) for row in rows)


def test_appid_ignores_case_and_has_no_leading_zero(spark):
    texts = [t for t in random_texts(400) if t.isascii()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hexes = df.select(
        appid_hex(crc64(F.lower("text"))).alias("a"), appid_hex(crc64(F.upper("text"))).alias("b")
    )
    assert hexes.filter("a <> b OR NOT a RLIKE '^[1-9A-F][0-9A-F]{0,15}$'").count() == 0


def test_known_folders(spark):
    folders = known_folders(spark)
    assert folders.count() == len(ROWS) == 92
    assert known_guids(folders).count() == 85


def test_known_folder_form_equals_the_whole_sequence(spark):
    keys = [key for key, _ in FOLDER_PATHS]
    texts = keys + [key.upper() for key in keys] + [key + "\\a" + key for key in keys] + ["%windir%windir%\\Fonts"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in appid.with_known_folder_form(df, "t").collect():
        want = row.t
        for key, guid in FOLDER_PATHS:
            want = want.replace(key, guid)
        assert row.known_folder_form == want


def test_guid_containment_equals_comparing_with_each(spark):
    guids = sorted({g for *_, g in ROWS})
    texts = [rf"x{a}{b}\f.exe" for a, b in zip(guids, reversed(guids))] + [r"{no}\f", r"{{%s\f" % guids[0][1:]]
    df = spark.createDataFrame(list(enumerate(texts)), "path_id int, path string")
    got = {(r.path_id, r.guid, r.name) for r in appid.guid_containment(df).collect()}
    want = {
        (i, guid, name)
        for i, text in enumerate(texts)
        for _, _, name, guid in ROWS
        if guid in plain.upper(text.rsplit("\\", 1)[0])
    }
    assert got == want and want


def test_names(spark):
    df = spark.createDataFrame(
        [("9b9cdc69c1c24e2b.automaticDestinations-ms",), ("a.b.xml",), ("noext",), ("x.automaticDestinations-ms",)],
        "name string",
    )
    rows = {r.name: (r.appid, r.is_hex) for r in appid.decode_name(df).collect()}
    assert rows["9b9cdc69c1c24e2b.automaticDestinations-ms"] == ("9b9cdc69c1c24e2b", True)
    assert rows["a.b.xml"] == ("a.b", False) and rows["noext"] == ("noext", False)
    assert rows["x.automaticDestinations-ms"] == ("x", False)
    stem = df.select(file_stem("name").alias("s"), appid.file_name(F.lit("AB")).alias("n")).first()
    assert stem.n == "ab.automaticDestinations-ms"


def test_functions_in_sql(spark):
    register_functions(spark)
    row = spark.sql("SELECT ltrim('0', hex(appid_crc64('Microsoft.Windows.Explorer'))) AS appid").first()
    assert row.appid == "F01B4D95CF55D32A"
