"""Suffix-array dedup of bytes by a logarithmic family of indexes.

Every byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller id is removed. A
suffix array of every byte would not fit the disk a task may use, so suffixes are sampled: of the windows of LENGTH
bytes, consecutive ones whose smallest hash of KEY bytes is the same form a run, and the array holds one entry a run:
that hash, a fingerprint of the run's bytes, document and place, sorted. Equal strings have equal runs but at their
ends, wherever they stand, so no match is missed.

A batch of documents gets its array, and copies inside the batch are settled there, so however many copies a string
has, a batch sends on one document's. Arrays are dealt by hash range. In each range a family of levels takes one
batch after another: the batch is merge-scanned against the levels for equal entries, the larger id is covered, and
levels of equal size are merged. Runs that share their hash with other runs but are not the same (the ends of
matches, and strings alike by chance) go into a second round that brings their bytes and compares every window of
theirs through the same family; if very many runs share one hash, their windows are dealt by the window's own hash.

Defined results: a null text is empty and keeps the digest of no bytes; a null id neither covers nor is covered; rows
that share an id do not cover each other; repeated rows are returned each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.llm.text_arrays import MULTIPLIER, byte_codes, mix, ranking_of, raw_bytes, small_batches
from jumptrail.shared import written

LENGTH = 50
KEY = 24
BATCH = 32 << 20  # bytes of text in a batch
SLICE = 1 << 17  # bytes hashed together: their hashes stay in a core's cache
CROWD = 2048  # different runs of one hash in a range from which their windows are dealt alone

ENTRY = np.dtype([("key", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("many", "<i4")])


def gram_hashes(data: np.ndarray, size: int, codes: np.ndarray) -> np.ndarray:
    """The hash of the `size` bytes from every position on."""
    part, width, done, total = codes[data], 1, 0, None
    left = size
    while left:
        if left & 1:
            if total is None:
                total, done = part, width
            else:
                rows = data.size - done - width + 1
                total = total[:rows] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + part[done : done + rows]
                done += width
        left >>= 1
        if left:
            rows = data.size - 2 * width + 1
            part = part[:rows] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + part[width : width + rows]
            width *= 2
    return mix(total)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    part, reach = values, 1
    while 2 * reach <= width:
        part = np.minimum(part[: part.size - reach], part[reach:])
        reach *= 2
    rows = values.size - width + 1
    return np.minimum(part[:rows], part[width - reach : width - reach + rows])


def fingerprints(windows: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A hash of all bytes of every run: of its first and last window, and of others between them if these leave a gap.

    A run is as long as one hash stays the smallest, which has no bound where a string repeats itself."""
    mark = mix(windows[start] * np.uint64(3) + windows[start + many - 1] * np.uint64(MULTIPLIER) + many.astype(np.uint64))
    gap = np.flatnonzero(many > LENGTH + 1)
    if gap.size:
        inner = (many[gap].astype(np.int64) - 1) // LENGTH
        first = np.cumsum(inner) - inner
        step = np.arange(inner.sum()) - np.repeat(first, inner) + 1
        between = windows[np.repeat(start[gap], inner) + step * LENGTH]
        mark[gap] = mix(mark[gap] + np.add.reduceat(mix(between + step.astype(np.uint64) * np.uint64(MULTIPLIER)), first))
    return mark


def runs(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start in the text, number of windows, hash and fingerprint of every run."""
    if data.size < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    least = sliding_least(gram_hashes(data, KEY, codes), LENGTH - KEY + 1)
    inside = np.zeros(least.size + 1, np.int32)
    ends = np.maximum(bounds[1:] - LENGTH + 1, bounds[:-1])
    np.add.at(inside, np.minimum(bounds[:-1], least.size), 1)
    np.add.at(inside, np.minimum(ends, least.size), -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    if not at.size:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    key = least[at]
    text = np.searchsorted(bounds, at, side="right") - 1
    fresh = np.ones(at.size, bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    many = np.diff(np.append(first, at.size))
    start, text, key = at[first], text[first], key[first]
    windows = gram_hashes(data, LENGTH, codes)
    return text, start - bounds[text], many, key, fingerprints(windows, start, many)


def ranking(entries: np.ndarray) -> np.ndarray:
    """The order of entries by key, print and document."""
    return ranking_of(entries["key"].copy(), entries["doc"], entries["print"])


def settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries of the smallest document of each (key, print), and those of larger documents: they are covered."""
    entries = entries.take(ranking(entries))
    if not entries.size:
        return entries, entries
    fresh = np.ones(entries.size, bool)
    fresh[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["print"][1:] != entries["print"][:-1])
    least = entries["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    larger = entries["doc"] > least
    return entries.take(np.flatnonzero(~larger)), entries.take(np.flatnonzero(larger))


class Levels:
    """Sorted arrays whose sizes grow geometrically; each new one is scanned against all and merged upwards."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> list[np.ndarray]:
        """Entries that turn out to be covered, of the batch or of earlier ones."""
        batch, found = settle(batch)
        covered = [found]
        self.levels.append(batch)
        while len(self.levels) > 1 and self.levels[-2].size <= 2 * self.levels[-1].size:
            merged, found = settle(np.concatenate((self.levels[-2], self.levels.pop())))
            self.levels[-1] = merged
            covered.append(found)
        return covered

    def close(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """All entries that are left in one array, and what is covered by them."""
        covered = []
        while len(self.levels) > 1:
            merged, found = settle(np.concatenate((self.levels.pop(), self.levels.pop())))
            self.levels.append(merged)
            covered.append(found)
        return (self.levels[0] if self.levels else np.empty(0, ENTRY)), covered


def packed(entries: np.ndarray) -> bytes:
    """Entries byte by byte of each field, which leaves the empty high bytes together."""
    import zstandard

    planes = [np.ascontiguousarray(entries[name]).view(np.uint8).reshape(entries.size, -1).T.tobytes() for name in ENTRY.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    rows = data.size // ENTRY.itemsize
    entries, place = np.empty(rows, ENTRY), 0
    for name in ENTRY.names:
        kind = ENTRY[name]
        planes = data[place : place + rows * kind.itemsize].reshape(kind.itemsize, rows)
        entries[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        place += rows * kind.itemsize
    return entries


def spans_batch(entries: np.ndarray, state: int) -> pa.RecordBatch:
    """Runs as rows: 0 covered, 1 to be looked at again, 2 the same in a crowd."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(entries["doc"]),
            pa.array(entries["tag"].astype(np.int64)),
            pa.array(entries["start"]),
            pa.array(entries["many"]),
            pa.array(np.full(entries.size, state, np.int32)),
        ],
        ["doc_id", "tag", "start", "many", "state"],
    )


SPANS = "doc_id long, tag long, start int, many int, state int"
DEALT = "bucket int, part binary, covered boolean, texts binary"


def dealt(entries: np.ndarray, buckets: int, texts: list[bytes] | None = None, covered: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of packed entries by hash range, with the bytes of their runs if these are given."""
    where = (entries["doc"].astype(np.uint64) if covered else entries["key"] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    side_by_side = entries.take(order)
    rows: list[tuple] = []
    for bucket in range(buckets):
        chosen = order[cuts[bucket] : cuts[bucket + 1]]
        if chosen.size:
            together = None
            if texts is not None:
                import zstandard

                together = zstandard.ZstdCompressor(level=1).compress(b"".join([texts[row] for row in chosen]))
            rows.append((bucket, packed(side_by_side[cuts[bucket] : cuts[bucket + 1]]), covered, together))
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.binary(), pa.bool_(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["bucket", "part", "covered", "texts"])


def tag() -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64("text")


def as_entries(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, tags: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    entries = np.empty(key.size, ENTRY)
    for name, values in zip(ENTRY.names, (key, mark, doc, tags, start, many)):
        entries[name] = values
    return entries


def first_round(docs: DataFrame, buckets: int) -> DataFrame:
    """What is covered by equal runs, and which runs must be looked at again."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, waiting, size = byte_codes(False), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                entries, covered = settle(np.concatenate(waiting))
                yield from dealt(entries, buckets)
                yield from dealt(covered, buckets, covered=True)

        for batch in small_batches(batches, 0, SLICE):
            data, bounds = raw_bytes(batch.column(0))
            text, start, many, key, mark = runs(data, bounds, codes)
            doc, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            waiting.append(as_entries(key, mark, doc[text], tags[text], start, many))
            size += data.size
            if size > BATCH:
                yield from flush()
                waiting, size = [], 0
        yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        for batch in batches:
            for part, covered in zip(batch.column(1), batch.column(2)):
                entries = unpacked(part.as_py())
                found = [entries] if covered.as_py() else levels.add(entries)
                yield from (spans_batch(one, 0) for one in found if one.size)
        entries, found = levels.close()
        yield from (spans_batch(one, 0) for one in found if one.size)
        if entries.size:
            fresh = np.ones(entries.size, bool)
            fresh[1:] = entries["key"][1:] != entries["key"][:-1]
            first = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            low = np.minimum.reduceat(entries["doc"], first)
            high = np.maximum.reduceat(entries["doc"], first)
            again = (low < high)[group]
            crowd = (np.diff(np.append(first, entries.size)) > CROWD)[group]
            yield spans_batch(entries[again & ~crowd], 1)
            yield spans_batch(entries[again & crowd], 2)

    known = docs.filter("doc_id is not null and octet_length(text) >= 50")
    parts = known.select("text", "doc_id", tag().alias("tag")).mapInArrow(arrays, DEALT)
    return written(parts.repartitionById(buckets, F.col("bucket")).mapInArrow(compare, SPANS), "spans")


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents with the runs found in them, side by side."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "many", "state")).alias("spans"))
    keyed = docs.select("text", "doc_id", tag().alias("tag"))
    return keyed.join(lists, ["doc_id", "tag"], how).select("text", "doc_id", "tag", "spans")


def second_round(docs: DataFrame, again: DataFrame, buckets: int) -> DataFrame:
    """What is covered among the windows of runs that were not equal."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(False)
        for batch in small_batches(batches, 0):
            data, bounds = raw_bytes(batch.column(0))
            doc, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists = batch.column(3)
            each = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, many, state = (flat.field(name).to_numpy() for name in ("start", "many", "state"))
            text = np.repeat(np.arange(batch.num_rows), each)
            alone = np.where(state == 2, many, 1)
            row = np.repeat(np.arange(text.size), alone)
            step = np.arange(row.size) - np.repeat(np.cumsum(alone) - alone, alone)
            start, many = start[row] + step, np.where(state[row] == 2, 1, many[row])
            text = text[row]
            windows, grams = gram_hashes(data, LENGTH, codes), sliding_least(gram_hashes(data, KEY, codes), LENGTH - KEY + 1)
            at = bounds[text] + start
            key = np.where(state[row] == 2, windows[at], grams[at])
            mark = fingerprints(windows, at, many)
            entries = as_entries(key, mark, doc[text], tags[text], start, many)
            order = ranking(entries)
            kept, covered = settle(entries)
            larger = np.zeros(entries.size, bool)
            if covered.size:
                fresh = np.ones(entries.size, bool)
                ranked = entries[order]
                fresh[1:] = (ranked["key"][1:] != ranked["key"][:-1]) | (ranked["print"][1:] != ranked["print"][:-1])
                larger[order] = ranked["doc"] > ranked["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                yield from dealt(covered, buckets, covered=True)
            stay = np.flatnonzero(~larger)
            view = data.tobytes()
            texts = [view[a:b] for a, b in zip(at[stay].tolist(), (at[stay] + many[stay] + LENGTH - 1).tolist())]
            yield from dealt(entries[stay], buckets, texts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codes, levels = byte_codes(False), Levels()
        found: list[np.ndarray] = []
        for batch in batches:
            for part, covered, texts in zip(batch.column(1), batch.column(2), batch.column(3)):
                entries = unpacked(part.as_py())
                if covered.as_py():
                    yield spans_batch(entries, 0)
                    continue
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts.as_py()), np.uint8)
                many = entries["many"].astype(np.int64)
                sizes = many + LENGTH - 1
                begin = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(entries.size), many)
                step = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)
                window = gram_hashes(data, LENGTH, codes)[begin[row] + step]
                alone = entries[row]
                alone["key"], alone["print"], alone["many"] = window, 0, 1
                alone["start"] += step.astype(np.int32)
                found += levels.add(alone)
        found += levels.close()[1]
        yield from (spans_batch(one, 0) for one in found if one.size)

    given = with_spans(docs, again, "inner")
    parts = given.mapInArrow(arrays, DEALT)
    return written(parts.repartitionById(buckets, F.col("bucket")).mapInArrow(compare, SPANS), "spans")


def covered_bytes(size: int, spans: pa.ListScalar) -> np.ndarray:
    """Which bytes of a text are covered."""
    change = np.zeros(size + 1, np.int64)
    if spans.is_valid and len(spans.values):
        start = spans.values.field("start").to_numpy().astype(np.int64)
        end = start + spans.values.field("many").to_numpy() + LENGTH - 1
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document with doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = first_round(docs, buckets)
    more = second_round(docs, spans.filter("state > 0"), buckets)
    every = spans.filter("state = 0").union(more)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            data, bounds = raw_bytes(batch.column(0))
            rows = []
            for number, spans in enumerate(batch.column(3)):
                text = data[bounds[number] : bounds[number + 1]]
                mask = covered_bytes(text.size, spans)
                edges = np.count_nonzero(mask[1:] & ~mask[:-1]) + int(mask.size > 0 and mask[0])
                rows.append((text.size, int(mask.sum()), edges, text[~mask].tobytes()))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(column, kind) for column, kind in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return with_spans(docs, every, "left").mapInArrow(
        keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
