"""One case table for columns and checksums; checksums by blocks equal those by characters."""

from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from jumptrail.functions import case, crc64
from jumptrail.functions.text import upper_invariant


def test_both_paths_agree_on_every_character_up_to_ffff(spark):
    points = [point for point in range(1, 0x10000) if not 0xD800 <= point <= 0xDFFF]
    df = spark.createDataFrame([(point, "é" + chr(point)) for point in points], "point int, text string")
    rows = df.select("point", upper_invariant("text").alias("upper"), crc64.crc64("text").alias("bits")).collect()
    table = case.upper_table()
    for row in rows:
        assert row["upper"] == "É" + chr(table[row["point"]])
    known = {}
    for row in rows:
        pair = (0xC9, int(table[row["point"]]) & 0xFF)
        if pair not in known:
            crc = plain.step(plain.step(crc64.START, pair[0]), 0)
            known[pair] = plain.step(plain.step(crc, pair[1]), 0)
        assert row["bits"] % (1 << 64) == known[pair]


def test_table_agrees_with_the_jvm_where_both_know_a_letter(spark):
    upper = spark._jvm.java.lang.Character.toUpperCase
    table = case.upper_table()
    points = [*range(0x80, 0x600), *range(0x1E00, 0x2000), *range(0x2C00, 0x2E00), *range(0xA640, 0xA7C0), *range(0xFF00, 0xFF60)]
    other = {point: upper(point) for point in points if table[point] != upper(point)}
    kept = {ord(letter) for letter in case.KEPT_LETTERS + case.TOO_NEW}
    # Greek letters with iota have a title case, and no single upper case; U+2C5F is newer than some JVMs.
    assert {point for point in other if not 0x1F80 <= point <= 0x1FFC} <= kept | {0x2C5F}
    for letter in case.TOO_NEW + case.KEPT_LETTERS:
        assert table[ord(letter)] == ord(letter)


@pytest.mark.parametrize("slice_size", [1 << 22, 64, 7])
def test_blocks_equal_characters(slice_size, monkeypatch):
    monkeypatch.setattr(crc64, "SLICE", slice_size)
    dice = random.Random(slice_size)
    letters = "aZ09\\ ~éßżŻıſμ日本😀𐐨ÿ" + chr(0xFFFF) + "\x00"
    texts = ["", "a", "a" * 31, "a" * 32, "a" * 33, "😀" * 40, "é" * 700, None]
    texts += ["".join(dice.choices(letters, k=dice.randrange(300))) for _ in range(120)]
    got = crc64.checksums(pa.array(texts, pa.string()), crc64.Crc(), case.upper_table())
    assert got.tolist() == [plain.crc64(text or "") for text in texts]
    part = pa.array(texts, pa.string()).slice(3, 40)
    assert crc64.checksums(part, crc64.Crc(), case.upper_table()).tolist() == got[3:43].tolist()
    assert crc64.checksums(pa.array([], pa.string()), crc64.Crc(), case.upper_table()).tolist() == []


def test_zero_units_as_a_matrix():
    crc = crc64.Crc()
    values = np.array([1, crc64.START, 0x123456789ABCDEF], np.uint64)
    want = values.copy()
    for _ in range(77):
        want = (want >> np.uint64(16)) ^ crc.table[want & np.uint64(0xFFFF)]
    assert crc.shifted(values, np.array([77, 77, 77])).tolist() == want.tolist()
    assert crc.shifted(values, np.array([0, 0, 0])).tolist() == values.tolist()
