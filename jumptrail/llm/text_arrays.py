"""Whole Arrow batches of text as byte arrays: words and their hashes without a Python object per word.

A batch is looked at in slices of bounded size, so a very long text costs no more memory than a short one
beyond eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes looked at together; a slice ends at the next break between words.
SLICE = 1 << 17

MULTIPLIER = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2 ** 64


def mix(value: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    value = value * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z where case is folded."""
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def spaces() -> np.ndarray:
    """Which bytes part words: the space and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def powers(size: int, base: int) -> np.ndarray:
    values = np.full(size, base, np.uint64)
    values[0] = 1
    return np.cumprod(values, dtype=np.uint64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Hashes of the words of texts; one object serves all batches of a task."""

    def __init__(self, fold_case: bool = True, apart: np.ndarray | None = None) -> None:
        self.apart = spaces() if apart is None else apart
        self.codes = byte_codes(fold_case)
        self.grow(SLICE)

    def grow(self, size: int) -> None:
        self.up = powers(size, MULTIPLIER)
        self.down = powers(size, pow(MULTIPLIER, -1, 1 << 64))

    def slices(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts of the bytes that part no word."""
        start = 0
        while start < data.size:
            end = min(start + SLICE, data.size)
            if end < data.size and not self.apart[data[end]]:
                text_end = int(bounds[np.searchsorted(bounds, end)])
                step, found = end, text_end
                while step < text_end:
                    ahead = np.flatnonzero(self.apart[data[step : min(step + SLICE, text_end)]])
                    if ahead.size:
                        found = step + int(ahead[0])
                        break
                    step += SLICE
                end = found
            yield start, end
            start = end

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word in order, and where each text's words begin (with a last end)."""
        hashes, first = self.with_beginnings(data, bounds, ())
        return hashes[0], first

    def with_beginnings(
        self, data: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...]
    ) -> tuple[np.ndarray, np.ndarray]:
        """As above, with a row of hashes for the first bytes of each word, for each size; 0 where it is shorter."""
        hashes, starts = [np.empty((1 + len(sizes), 0), np.uint64)], [np.empty(0, np.int64)]
        for first, last in self.slices(data, bounds):
            part = data[first:last]
            if part.size > self.up.size:
                self.grow(1 << int(part.size - 1).bit_length())
            inside = ~self.apart[part]
            fresh = np.zeros(part.size + 1, bool)
            texts = bounds[np.searchsorted(bounds, first) : np.searchsorted(bounds, last)] - first
            fresh[texts] = True
            fresh[0] = fresh[-1] = True
            begin = inside.copy()
            begin[1:] &= ~inside[:-1] | fresh[1:-1]
            finish = inside.copy()
            finish[:-1] &= ~inside[1:] | fresh[1:-1]
            at, end = np.flatnonzero(begin), np.flatnonzero(finish)
            summed = np.cumsum(self.codes[part] * self.up[: part.size], dtype=np.uint64)
            before = np.where(at > 0, summed[at - 1], np.uint64(0))
            rows = [mix((summed[end] - before) * self.down[at])]
            for size in sizes:
                reached = np.minimum(at + size - 1, end)
                begun = mix((summed[reached] - before) * self.down[at])
                rows.append(np.where(at + size - 1 <= end, begun, np.uint64(0)))
            hashes.append(np.stack(rows))
            starts.append(at + first)
        return np.concatenate(hashes, axis=1), np.searchsorted(np.concatenate(starts), bounds)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text; the whole text as one where it has fewer, but some."""
    if not words.size:
        return words
    width = min(size, words.size)
    runs = words.size - width + 1
    total = np.full(runs, width, np.uint64)
    for step in range(width):
        total = total * np.uint64(MULTIPLIER) + words[step : step + runs]
    return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    values = np.sort(values)
    if values.size < 2:
        return values
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def ranking_of(key: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """The order that lexsort gives to (*ties, key): one sort of the keys, the rest only where keys are equal."""
    order = np.argsort(key)
    ranked = key[order]
    equal = np.zeros(order.size, bool)
    equal[1:] = ranked[1:] == ranked[:-1]
    equal[:-1] |= equal[1:]
    at = np.flatnonzero(equal)
    tied = order[at]
    order[at] = tied[np.lexsort((*(one[tied] for one in ties), ranked[at]))]
    return order


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column number `text`) have about `most` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = raw_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
