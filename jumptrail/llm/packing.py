"""Best-fit packing of documents into sequences of a fixed length by exact complements.

Documents become pieces of at most `length` tokens (only longer documents are cut). What is packed is the histogram
of piece lengths, which has at most `length` entries whatever the number of documents, so the plan is made on the
driver: from the longest length down, the gap that a piece leaves is looked up in an index of single lengths, then of
pair sums, then of triple sums, and the combinations that fill it exactly are used as often as their lengths are still
available. What finds no exact complement is packed best fit, longest first, again for all pieces of a length at once.
The plan is a list of patterns (lengths in a sequence) with the number of sequences of that pattern.

Every piece then takes its place: it has a number among the pieces of its length (a running number within its task,
plus what the tasks before hold, summed over a small table of counts per length and task), and the plan says which
numbers go where. No token moves: pieces refer to their document by start and length.

Defined results: a null text is an empty document, which is one piece holding only the end-of-document id; repeated
rows are packed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jumptrail.llm.tokens import Encoder, cut_lengths
from jumptrail.shared import written

LENGTH = 1024
LEAST = 2  # times that a pair or triple must be there to be used


PIECES = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("task", pa.int32()),
    ("seen", pa.int64()),
]


class Sums:
    """Which single lengths, pairs and triples add up to a gap, as an index by the sum, and how many of each length are left.

    An entry of the index is made when its sum is first asked for, from the lengths that are there at the start; it
    lists the longer lengths of the pairs, or the longest ones of the triples, in rising order."""

    def __init__(self, histogram: dict[int, int], length: int) -> None:
        self.counts = np.zeros(length + 1, np.int64)
        for n, count in histogram.items():
            self.counts[n] = max(count, 0)
        self.there = self.counts > 0
        self.lengths = np.flatnonzero(self.there[:length])
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, list[int]] = {}

    def available(self, combination: tuple[int, ...]) -> int:
        """How many times the combination can be taken."""
        return min(int(self.counts[n]) // times for n, times in Counter(combination).items())

    def longer_of_pairs(self, gap: int) -> np.ndarray:
        if gap not in self.pairs:
            longer = self.lengths[(2 * self.lengths >= gap) & (self.lengths < gap)]
            self.pairs[gap] = longer[self.there[gap - longer]]
        return self.pairs[gap]

    def longest_of_triples(self, gap: int) -> list[int]:
        if gap not in self.triples:
            longest = self.lengths[(3 * self.lengths >= gap) & (self.lengths < gap)].tolist()
            self.triples[gap] = [n for n in longest if self.longer_of_pairs(gap - n).size]
        return self.triples[gap]

    def single(self, gap: int) -> tuple[int, ...]:
        """The length that fills the gap, if one is left."""
        return (gap,) if self.counts[gap] else ()

    def pair(self, gap: int) -> tuple[int, ...]:
        """The two lengths that fill the gap and are left most often; of equal ones the most uneven."""
        longer = self.longer_of_pairs(gap)[::-1]
        if not longer.size:
            return ()
        shorter = gap - longer
        left = np.where(longer == shorter, self.counts[longer] // 2, np.minimum(self.counts[longer], self.counts[shorter]))
        best = int(left.argmax())
        return (int(longer[best]), int(shorter[best])) if left[best] else ()

    def triple(self, gap: int) -> tuple[int, ...]:
        """Three lengths that fill the gap, the longest one as short as possible."""
        for longest in self.longest_of_triples(gap):
            if self.counts[longest]:
                self.counts[longest] -= 1
                found = self.pair(gap - longest)
                self.counts[longest] += 1
                if found and found[0] <= longest:
                    return (longest, *found)
        return ()


def plan(histogram: dict[int, int], length: int = LENGTH, least: int = LEAST) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths with their numbers of sequences, together using up the histogram.

    Gaps are filled exactly by single lengths first, then by pairs, then by triples, each time from the longest
    length down. A pair or triple is taken where it can be taken `least` times: one that is there once spends short
    lengths that best fit would need at the end. What is left is packed best fit.
    """
    sums, patterns = Sums(histogram, length), []
    if sums.counts[length]:
        patterns.append(((length,), int(sums.counts[length])))
    for fill, enough in ((sums.single, 1), (sums.pair, least), (sums.triple, least)):
        for longest in sums.lengths[::-1].tolist():
            while sums.counts[longest]:
                sums.counts[longest] -= 1
                found = fill(length - longest)
                sums.counts[longest] += 1
                pattern = (longest, *found)
                times = sums.available(pattern) if found else 0
                if times < enough:
                    break
                patterns.append((pattern, times))
                for n in pattern:
                    sums.counts[n] -= times
    rest = Counter({n: int(sums.counts[n]) for n in sums.lengths.tolist() if sums.counts[n]})
    return patterns + best_fit(rest, length)


def best_fit(counts: Counter[int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequences it fits; equal sequences are handled together."""
    open_bins: dict[int, list[list]] = {}  # free tokens -> [pattern, number]
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], free: int, number: int) -> None:
        if free not in open_bins:
            open_bins[free] = []
            bisect.insort(gaps, free)
        open_bins[free].append([pattern, number])

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = length // n
                if left >= each:
                    put((n,) * each, length - each * n, left // each)
                if left % each:
                    put((n,) * (left % each), length - left % each * n, 1)
                break
            free = gaps[at]
            pattern, number = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free]
                gaps.pop(at)
            each = min(free // n, left)
            times = min(number, left // each)
            if number > times:
                put(pattern, free, number - times)
            put(pattern + (n,) * each, free - each * n, times)
            left -= each * times
    return [(pattern, number) for same in open_bins.values() for pattern, number in same]


class Places:
    """Where the piece with a given number among those of its length goes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter[int] = Counter()
        sequence = 0
        for pattern, number in patterns:
            offset = 0
            for n in pattern:
                runs.setdefault(n, []).append((used[n], sequence, offset))
                used[n] += number
                offset += n
            sequence += number
        self.runs = {n: tuple(np.array(column, np.int64) for column in zip(*rows)) for n, rows in runs.items()}
        self.sequences = sequence

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if lengths.size else []:
            first, start, place = self.runs[int(lengths[rows[0]])]
            run = np.searchsorted(first, numbers[rows], side="right") - 1
            sequence[rows] = start[run] + numbers[rows] - first[run]
            offset[rows] = place[run]
        return sequence, offset


def document_pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its task and number among the task's pieces of
    that length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encoder = TaskContext.get().partitionId(), Counter(), Encoder(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1))):
                start, view = 0, memoryview(ids)
                for piece, n in enumerate(cut_lengths(len(ids), length)):
                    rows.append((doc_id, piece, start, n, zlib.crc32(view[start : start + n]), task, seen[n]))
                    seen[n] += 1
                    start += n
            columns = list(zip(*rows)) if rows else [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, (_, kind) in zip(columns, PIECES)], [name for name, _ in PIECES]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, seen long"
    )


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Give each piece its sequence_id and offset. `pieces` must be a stored table, it is read three times."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, length))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("_length"),
        F.col("task").alias("_task"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            sequence, offset = places.of(np.array(rows["length"], np.int64), np.array(rows["number"], np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    numbered = pieces.join(
        offsets, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seen") + F.col("_before")).alias("number"))
    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack_pieces(written(document_pieces(docs, length, path), "pieces"), length)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
