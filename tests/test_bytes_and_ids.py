from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jumptrail.functions.binary import bytes_from_hex, has_odd_length, hexdump, reverse_bytes
from jumptrail.functions.ids import parse_id
from jumptrail.operators.identify import select_process

BLANKS = " \t\n\v\f\r"
HEX = "0123456789abcdefABCDEF"


def blobs(n: int) -> list[bytes]:
    rng = random.Random(3)
    return [rng.randbytes(rng.randrange(70)) for _ in range(n)] + [bytes(range(256)), rng.randbytes(50_000)]


def dump_line(row: bytes) -> tuple[str, str]:
    text = "".join(chr(b) if 32 < b < 254 and b != 127 else "." for b in row)
    return row.hex(" ").upper().ljust(50), text


def test_hexdump(spark):
    data = blobs(60)
    rows = list(enumerate(data)) + [(9998, b""), (9999, None)]
    df = spark.createDataFrame(rows, "id int, data binary")
    got = {(r.id, r.offset): (r.hex, r.text) for r in hexdump(df, "data", "id").collect()}
    want = {
        (i, at): dump_line(blob[at : at + 16]) for i, blob in enumerate(data) for at in range(0, len(blob), 16)
    }
    assert got == want


@pytest.mark.parametrize("offset", [0, 1, 16, 69])
def test_reverse_bytes(spark, offset):
    data = blobs(60)
    df = spark.createDataFrame([*enumerate(data), (9998, b""), (9999, None)], "id int, data binary")
    got = {r.id: r.b for r in df.select("id", reverse_bytes("data", offset).alias("b")).collect()}
    for i, blob in enumerate(data):
        want = bytes(reversed(blob[offset:])) if blob and offset <= len(blob) else None
        assert got[i] == (bytearray(want) if want is not None else None)
    assert got[9998] is None and got[9999] is None


def test_reverse_twice_is_identity(spark):
    data = [b for b in blobs(30) if b]
    df = spark.createDataFrame([(bytearray(b),) for b in data], "data binary")
    twice = df.select((reverse_bytes(reverse_bytes("data")) == F.col("data")).alias("same"))
    assert twice.filter("NOT same").count() == 0
    assert df.select(reverse_bytes("data", -1).alias("b")).filter("b IS NOT NULL").count() == 0


def pair_value(pair: str) -> int:
    if all(c in HEX for c in pair):
        return int(pair, 16)
    if pair[0] in BLANKS and pair[1] in HEX:
        return int(pair[1], 16)
    if pair[0] in HEX and pair[1] in BLANKS + "\0":
        return int(pair[0], 16)
    return 0


def test_bytes_from_hex(spark):
    rng = random.Random(5)
    texts = ["", "4142", "41G2", " A", "A ", "\tA", "A\0", "\0A", "  ", "é1", "😀41", "a😀b", "4", "41\n", "A;", ";;"]
    texts += ["".join(rng.choice(HEX + " ;G\n\0") for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["0G41" * 60_000, "4a" * 300_000 + "??" + "4b" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", bytes_from_hex("t").alias("b"), has_odd_length("t").alias("odd")).collect()
    for row in got:
        raw = texts[row.id].encode("utf-16-le")
        units = [chr(int.from_bytes(raw[i : i + 2], "little")) for i in range(0, len(raw), 2)]
        assert row.odd == (len(units) % 2 == 1)
        if row.odd:
            assert row.b is None
        else:
            pairs = ["".join(units[i : i + 2]) for i in range(0, len(units), 2)]
            assert bytes(row.b) == bytes(pair_value(pair) for pair in pairs)


IDS = {
    "42": 42, "0x2A": 42, "0X2a": 42, " 42 ": 42, "+42": 42, "\t+042\n": 42, "0x 2A": 42, "0x2A ": 42,
    "0x0000000000002A": 42, "00000000000042": 42, "4294967295": 4294967295, "0xFFFFFFFF": 4294967295,
    "4294967296": 0, "0x100000000": 0, "-5": 0, "-0": 0, "12zz": 0, "0xZZ": 0, "0x": 0, "": 0, " 0x10": 0,
    "0x+10": 0, "99999999999999999999": 0, "1 2": 0, "4\u0662": 0, "42\0": 42, None: 0, "0": 0,
}


def test_parse_id(spark):
    df = spark.createDataFrame([(t,) for t in IDS], "t string")
    assert {r.t: r.v for r in df.select("t", parse_id("t").alias("v")).collect()} == IDS


def test_select_process(spark):
    df = spark.createDataFrame([(0, "idle"), (42, "a"), (43, "b"), (42, "c")], "pid bigint, name string")
    names = lambda text: {r.name for r in select_process(df, text).collect()}
    assert names("0x2a") == names("42") == {"a", "c"}
    assert names("0") == names("nonsense") == set()
