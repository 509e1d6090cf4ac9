"""Fill-in-the-middle on texts kept as seekable compressed frames.

`store_frames` keeps every text as independent zstandard frames of at most FRAME bytes, one after the other, with
cumulative counts beside them: where each frame begins in the store, how many lines ended and how many code points
came before it. `fill_in_middle` finds the two cuts of a document by those counts, decompresses only the frames that
hold them, and writes the output as frames too: whole frames of the store go over as they are, the cut ones are
compressed anew, and every mark is a frame of its own. `digests` streams the ordered frames, one decompressed frame
at a time, and rebuilds the text from output and form alone: it finds the marks in the output, then reads prefix,
middle and suffix by seeking.

A document is one row from first to last, so nothing is shuffled, and copies or hot sources are no hot keys. A task
holds one text and its frames. The store is a written table, so a lost executor costs the frames it was cutting.

Defined results: a null text is empty; an empty text, one that contains a mark, and one that the rate leaves out
have the form `plain`; a line may be longer than a frame; repeated rows and rows that share an id are cut each, the
same way if their texts are equal; a null id is hashed as no digits; an empty table gives an empty table; columns
of other names are ignored. Marks are told apart by the bytes of the text, so no text need be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.shared import written

FRAME = 1 << 16
LEVEL = 1

# Marks, and the order of the parts in each form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLAIN = "plain"

SALT = "7"
RATE = 100  # percent of the texts that are cut
SPM_RATE = 50  # percent of those in the order suffix, prefix, middle

# Bytes of rows that a task holds before it hands them on.
HANDED_ON = 8 << 20

STORED = "doc_id long, n long, marked boolean, frames binary, at array<long>, lines array<long>, chars array<long>"
FORMED = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "output binary, at array<long>, bytes array<long>"
)
DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


def code_points(data: bytes) -> int:
    """Characters of UTF-8 bytes: those that do not continue another."""
    values = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero((values & 0xC0) != 0x80))


class Frames:
    """Independent compressed frames with their beginnings (and the end) in several counts."""

    def __init__(self, compressor: zstandard.ZstdCompressor) -> None:
        self.compressor = compressor
        self.parts: list[bytes] = []
        self.at, self.bytes = [0], [0]

    def add(self, data: bytes) -> None:
        """The data as one more frame; nothing for no data."""
        if data:
            self.ready(self.compressor.compress(data), [0], [0], len(data))

    def ready(self, frames: bytes, at: list[int], before: list[int], size: int) -> None:
        """Frames as they are: their beginnings in `frames`, the bytes before each, and the bytes in all."""
        start, done = self.at.pop(), self.bytes.pop()
        self.parts.append(frames)
        self.at += [start + x for x in at] + [start + len(frames)]
        self.bytes += [done + x for x in before] + [done + size]


def cut_frames(text: bytes, size: int = FRAME) -> Iterator[bytes]:
    """The text in stretches of at most `size` bytes, after a line's end where there is one."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            end = text.rfind(b"\n", start, end) + 1 or end
        yield text[start:end]
        start = end


def _handed_on(rows: Iterator[tuple[int, tuple]], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their size in bytes."""
    waiting, held = [], 0
    for size, row in rows:
        waiting.append(row)
        held += size + 200
        if held > HANDED_ON:
            yield _batch(waiting, types, names)
            waiting, held = [], 0
    yield _batch(waiting, types, names)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, types)], names)


def _types(schema: str) -> tuple[list[pa.DataType], list[str]]:
    known = {
        "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
    }
    fields = [field.split(" ") for field in schema.split(", ")]
    return [known[kind] for _, kind in fields], [name for name, _ in fields]


def store_frames(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """A row per document: its lines (n), whether it contains a mark, its frames, and of every frame the beginning,
    the lines that ended and the code points before it (with a last entry for the end)."""

    def stored(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple:
        frames, lines, chars = Frames(compressor), [0], [0]
        for part in cut_frames(text, frame):
            frames.add(part)
            lines.append(lines[-1] + part.count(b"\n"))
            chars.append(chars[-1] + code_points(part))
        n = lines[-1] + (not text.endswith(b"\n") if text else 0)
        marked = any(mark in text for mark in MARKS.values())
        return n, marked, b"".join(frames.parts), frames.at, lines, chars

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    row = stored(text.as_py() or b"", compressor)
                    yield len(row[2]), (doc_id.as_py(), *row)

        return _handed_on(rows(), *_types(STORED))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(task, STORED)


def draws(doc_id: int | None, salt: str = SALT) -> list[int]:
    """Four numbers from the id."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


class Cut:
    """A place after some whole lines: the frame it is in, what of that frame is on each side, code points before."""

    def __init__(self, row: dict, line: int, decompressor: zstandard.ZstdDecompressor) -> None:
        lines, chars = row["lines"], row["chars"]
        last = len(lines) - 1
        if line == 0 or line >= row["n"]:
            self.frame = 0 if line == 0 else last
            self.left = self.right = b""
            self.whole = True
            self.chars = chars[self.frame]
            return
        self.frame = int(np.searchsorted(lines, line)) - 1
        data = decompressor.decompress(row["frames"][row["at"][self.frame] : row["at"][self.frame + 1]])
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        place = int(ends[line - lines[self.frame] - 1]) + 1
        self.left, self.right, self.whole = data[:place], data[place:], False
        self.chars = chars[self.frame] + code_points(self.left)


def _stretch(row: dict, out: Frames, start: Cut, end: Cut, sizes: list[int]) -> None:
    """What lies between two cuts, whole frames as they are."""
    if not start.whole and not end.whole and start.frame == end.frame:
        out.add(start.right[: len(end.left) - len(start.left)])
        return
    out.add(start.right)
    first, last = start.frame + (not start.whole), end.frame
    if first < last:
        at = row["at"]
        out.ready(
            row["frames"][at[first] : at[last]],
            [x - at[first] for x in at[first:last]],
            [x - sizes[first] for x in sizes[first:last]],
            sizes[last] - sizes[first],
        )
    out.add(end.left)


def fill_in_middle(stored: DataFrame, salt: str = SALT, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Documents of `store_frames` in their new order: form, code points of prefix and middle (null if plain), and
    the output as frames with the beginning and the bytes before each."""

    def formed(row: dict, compressor, decompressor) -> tuple:
        h1, h2, h3, h4 = draws(row["doc_id"], salt)
        n, at = row["n"], row["at"]
        out = Frames(compressor)
        sizes = [0]
        for i in range(len(at) - 1):
            head = row["frames"][at[i] : min(at[i + 1], at[i] + 18)]
            sizes.append(sizes[-1] + zstandard.frame_content_size(head))
        if n == 0 or row["marked"] or h3 % 100 >= rate:
            return n, PLAIN, None, None, row["frames"], at, sizes
        form = "spm" if h4 % 100 < spm_rate else "psm"
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        cuts = [Cut(row, line, decompressor) for line in (0, low, high, n)]
        between = dict(zip(("prefix", "middle", "suffix"), zip(cuts, cuts[1:])))
        for part in ORDERS[form]:
            out.add(MARKS[part])
            _stretch(row, out, *between[part], sizes)
        return n, form, cuts[1].chars, cuts[2].chars - cuts[1].chars, b"".join(out.parts), out.at, out.bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    made = formed(row, *tools)
                    yield len(made[4]), (row["doc_id"], *made)

        return _handed_on(rows(), *_types(FORMED))

    return stored.mapInArrow(task, FORMED)


class Output:
    """Reads frames, one at a time."""

    def __init__(self, frames: bytes, at: list[int], before: list[int], decompressor: zstandard.ZstdDecompressor) -> None:
        self.frames, self.at, self.before, self.decompressor = frames, at, before, decompressor

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from `start` to `end` in pieces; frames outside are not touched."""
        number = max(int(np.searchsorted(self.before, start, side="right")) - 1, 0)
        while start < end:
            data = self.decompressor.decompress(self.frames[self.at[number] : self.at[number + 1]])
            first = self.before[number]
            yield data[start - first : end - first]
            number += 1
            start = first + len(data)

    def scan(self, digest) -> dict[str, int]:
        """Feeds the digest all frames in order; where each mark begins."""
        found: dict[str, int] = {}
        tail, done = b"", 0
        for data in self.read(0, self.before[-1]):
            digest.update(data)
            data = tail + data
            for part, mark in MARKS.items():
                place = data.find(mark)
                if place >= 0:
                    found[part] = done - len(tail) + place
            done += len(data) - len(tail)
            tail = data[-2:]
        return found

    def parts(self, found: dict[str, int]) -> Iterator[bytes]:
        """Prefix, middle and suffix, in this order."""
        starts = sorted(found.values())
        for part in ("prefix", "middle", "suffix"):
            later = [start for start in starts if start > found[part]]
            yield from self.read(found[part] + len(MARKS[part]), later[0] if later else self.before[-1])


def digests(formed: DataFrame) -> DataFrame:
    """SHA-256 of the output, and of the text rebuilt from output and form."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    output = Output(row["output"], row["at"], row["bytes"], decompressor)
                    whole, rebuilt = hashlib.sha256(), hashlib.sha256()
                    found = output.scan(whole)
                    if row["form"] == PLAIN:
                        rebuilt = whole
                    else:
                        for data in output.parts(found):
                            rebuilt.update(data)
                    yield 0, (
                        row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"],
                        whole.hexdigest(), rebuilt.hexdigest(),
                    )

        return _handed_on(rows(), *_types(DIGESTS))

    return formed.mapInArrow(task, DIGESTS)


def output_texts(formed: DataFrame) -> DataFrame:
    """doc_id, form and the output as text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    output = Output(row["output"], row["at"], row["bytes"], decompressor)
                    text = b"".join(output.read(0, row["bytes"][-1]))
                    yield len(text), (row["doc_id"], row["form"], text)

        return _handed_on(rows(), *_types("doc_id long, form string, text binary"))

    made = formed.mapInArrow(task, "doc_id long, form string, text binary")
    return made.withColumn("text", F.col("text").cast("string"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_frames(spark.read.parquet(f"{sf_dir}/documents.parquet")), "frames")
    return digests(fill_in_middle(stored))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, t, p, (len(p) - (p[-1] = '')::INT)::BIGINT AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), s AS (
  SELECT doc_id, n, form, t,
    array_to_string(p[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(p) THEN chr(10) ELSE '' END AS pre,
    array_to_string(p[a + 1:b], chr(10)) || CASE WHEN b > a AND b < len(p) THEN chr(10) ELSE '' END AS mid,
    array_to_string(p[b + 1:len(p)], chr(10)) AS suf
  FROM f
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""
