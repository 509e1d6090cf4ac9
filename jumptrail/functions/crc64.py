"""CRC-64 of text as an Arrow UDF: blocks of all rows of a batch advance together and are combined over bits."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from jumptrail.functions.case import upper_table

# Fixed values of the checksum: reflected polynomial, start value; no final xor.
POLYNOMIAL = 0x92C64265D32139A4
START = 0xFFFFFFFFFFFFFFFF

# Rows are looked at together up to this many bytes; a longer row is cut at characters.
SLICE = 1 << 22

# Units of a block; the checksums of the blocks of a row are combined afterwards.
BLOCK = 32

# The UDF carries these modules along, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def byte_table() -> np.ndarray:
    """CRC of every single byte value."""
    crc = np.arange(256, dtype=np.uint64)
    one = np.uint64(1)
    for _ in range(8):
        crc = np.where(crc & one, (crc >> one) ^ np.uint64(POLYNOMIAL), crc >> one)
    return crc


def unit_table() -> np.ndarray:
    """Two byte steps in one lookup: a character's low byte, then a zero byte."""
    table = byte_table()
    value = np.arange(1 << 16, dtype=np.uint64)
    low = table[value & np.uint64(0xFF)]
    return (low >> np.uint64(8)) ^ table[(value >> np.uint64(8)) ^ (low & np.uint64(0xFF))]


class Shift:
    """What a checksum becomes when zero units follow: a matrix over bits, as a table for each byte of the checksum."""

    def __init__(self, images: np.ndarray) -> None:
        """`images` of the 64 single bits."""
        self.images = images
        value = np.arange(256)
        self.tables = np.zeros((8, 256), np.uint64)
        for place in range(8):
            for bit in range(8):
                self.tables[place] ^= np.where(value >> bit & 1, images[8 * place + bit], np.uint64(0))

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        out = self.tables[0][crc & np.uint64(0xFF)]
        for place in range(1, 8):
            out ^= self.tables[place][(crc >> np.uint64(8 * place)) & np.uint64(0xFF)]
        return out

    def twice(self) -> Shift:
        return Shift(self(self.images))


class Crc:
    """Checksums of many rows of units at once: of blocks first, then of rows by combining them pair by pair."""

    def __init__(self) -> None:
        self.table = unit_table()
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        # One zero unit; then as many as each power of two says.
        self.shifts = [Shift((bits >> np.uint64(16)) ^ self.table[bits & np.uint64(0xFFFF)])]

    def shift(self, power: int) -> Shift:
        while len(self.shifts) <= power:
            self.shifts.append(self.shifts[-1].twice())
        return self.shifts[power]

    def shifted(self, crc: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Each checksum as it is after so many zero units."""
        for power in range(int(units.max(initial=0)).bit_length()):
            crc = np.where(units >> power & 1, self.shift(power)(crc), crc)
        return crc

    def from_zero(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Checksum of each row, begun with zero; `counts` units belong to each. Zeros before a row change nothing,
        so rows are filled up to whole blocks in front."""
        blocks = -(-counts // BLOCK)
        ends = np.cumsum(blocks)
        padded = np.zeros(int(ends[-1]) * BLOCK if ends.size else 0, np.uint8)
        moved = ends * BLOCK - np.cumsum(counts)
        padded[np.arange(units.size) + np.repeat(moved, counts)] = units
        columns = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
        crc, low, by = np.zeros(columns.shape[1], np.uint64), np.uint64(0xFFFF), np.uint64(16)
        for column in columns:
            crc = (crc >> by) ^ self.table[(crc ^ column) & low]
        row = np.repeat(np.arange(counts.size), blocks)
        after = np.repeat(ends, blocks) - 1 - np.arange(row.size)  # blocks that follow in the row
        power = BLOCK.bit_length() - 1
        while after.max(initial=0):
            odd = (after & 1).astype(bool)
            crc[odd] = self.shift(power)(crc[odd])
            # A pair is one odd block and the even one behind it; a first block may be alone.
            first = np.ones(row.size, bool)
            first[1:] = (row[1:] != row[:-1]) | (after[1:] // 2 != after[:-1] // 2)
            starts = np.flatnonzero(first)
            crc = np.bitwise_xor.reduceat(crc, starts)
            row, after, power = row[starts], after[starts] // 2, power + 1
        out = np.zeros(counts.size, np.uint64)
        out[row] = crc
        return out

    def rows(self, data: np.ndarray, bounds: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Checksum of every row of UTF-8 bytes, upper-cased by a table."""
        out = np.empty(bounds.size - 1, np.uint64)
        start = 0
        while start < out.size:
            end = int(np.searchsorted(bounds, bounds[start] + SLICE, side="right")) - 1
            if end > start:
                part = data[bounds[start] : bounds[end]]
                units, counts = low_units(part, bounds[start : end + 1] - bounds[start], upper)
                out[start:end] = self.from_zero(units, counts) ^ self.shifted(np.full(counts.size, START, np.uint64), counts)
            else:
                end = start + 1
                out[start] = self.long(data[bounds[start] : bounds[end]], upper)
            start = end
        return out

    def long(self, data: np.ndarray, upper: np.ndarray) -> np.uint64:
        """Checksum of one long row, slice by slice."""
        crc, start = np.array([START], np.uint64), 0
        while start < data.size:
            end = min(start + SLICE, data.size)
            while end < data.size and data[end] & 0xC0 == 0x80:
                end += 1
            units, counts = low_units(data[start:end], np.array([0, end - start]), upper)
            crc = self.shifted(crc, counts) ^ self.from_zero(units, counts)
            start = end
        return crc[0]


def low_units(data: np.ndarray, bounds: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes of the UTF-16 units of upper-cased rows of UTF-8 bytes, and how many each row has."""
    if not (data & 0x80).any():
        return (upper[data] & 0xFF).astype(np.uint8), np.diff(bounds)
    begins = np.flatnonzero(data & 0xC0 != 0x80)
    lead = data[begins].astype(np.uint32)
    size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    point = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for more in (1, 2, 3):
        longer = np.flatnonzero(size > more)
        following = data[np.minimum(begins[longer] + more, data.size - 1)]
        point[longer] = (point[longer] << 6) | (following & 0x3F)
    chars = np.searchsorted(begins, bounds)
    pair = point > 0xFFFF
    low = (upper[np.where(pair, 0, point)] & 0xFF).astype(np.uint8)
    if not pair.any():
        return low, np.diff(chars)
    places = np.arange(point.size) + np.cumsum(pair) - pair
    units = np.empty(point.size + int(pair.sum()), np.uint8)
    units[places] = np.where(pair, ((point - 0x10000) >> 10) & 0xFF, low).astype(np.uint8)
    units[places[pair] + 1] = (point[pair] & 0xFF).astype(np.uint8)
    before = np.concatenate(([0], np.cumsum(np.where(pair, 2, 1))))
    return units, np.diff(before[chars])


def checksums(texts: pa.Array, crc: Crc, upper: np.ndarray) -> np.ndarray:
    """CRC of every text; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return crc.rows(data[bounds[0] : bounds[-1]], bounds - bounds[0], upper)


def _udf(upper: np.ndarray):
    @F.arrow_udf(LongType())
    def crc64_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crc = Crc()
        for texts in batches:
            bits = checksums(texts, crc, upper).view(np.int64)
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            yield pa.array(bits, pa.int64(), mask=missing)

    return crc64_of


_crc64 = _udf(upper_table())


def crc64(text: Column | str) -> Column:
    """CRC-64 of the upper-cased text as BIGINT bits; null for null."""
    return _crc64(text)
