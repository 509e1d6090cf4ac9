"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its distinct words (A-Z as a-z). A line is removed if a line that comes earlier (smaller doc_id,
then smaller line number) has a Jaccard similarity of `percent` or more with it; lines are judged on the input, not
on what is left, and lines of fewer than `least_words` distinct words are left alone; the query leaves none alone.

Lines of one set are one row of the join, however many copies there are. A set so small that one word more or less
already makes it too different is like none but its copies, which are found by the set's hash, so it stays out of the
join. Words are ordered by rarity (counts in a
table of `RARITY` hash buckets, ties by hash: a fixed order, so the filters stay exact) and a set is filed under the
words of its prefix. A pair is a candidate if it shares a prefix word, its sizes and the positions of that word allow
the overlap, and their sketches differ by no more than the words in which they may differ. A sketch counts a set's words
by hash, modulo 16, in 16 places (64 bits) in the file and in 64 places after it: one word more or less changes one
count by one. Candidates are verified on their full sets. Entries move packed, dealt by word; of those under a word only the ones
that have a candidate there are stored, by word, so nothing of the file is shuffled twice and the joins meet few rows. The first pass
compares each set only with the earliest set under each of its words; sets that this removes are done, and only the
others meet everything under their words, so many variants of one line do not yield all their pairs.

Defined results: a null text has no lines; an empty line has no words and is never removed; a null id counts as
later than all others; rows that repeat an id are ordered by their text's hash; an empty table gives an empty table;
other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.llm.near_duplicates import document_key
from jumptrail.llm.text_arrays import Words, distinct, mix, ranking_of, raw_bytes, small_batches
from jumptrail.shared import bucketed, unbucketed, written

RARITY = 1 << 17
MARKS = 1 << 24  # bits of the table that says which sets to fetch
PLACES = 16  # counts in one number of a sketch, each of four bits
WIDE = ("w0", "w1", "w2", "w3")  # columns of the sketch that pairs meet before their full sets do
BROADCAST_ROWS = 2_000_000
SEEN = 200_000  # sets a task remembers having filed
WAITING = 1 << 20  # entries a task holds before it deals them
PARTS = 4  # ranges of words in a shuffle partition, compared one after the other
LINE_BREAK = 10
BITS = 40  # of a word's hash, enough within a line; pairs are verified on all 64

# A set under a word of its prefix (as its place in the order of rarity); doc_id is the smallest so far.
ENTRY = np.dtype([("token", "<i8"), ("set", "<i8"), ("sketch", "<i8"), ("doc_id", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def last_if_null(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin (with a last end), and how many lines each text has; breaks belong to the line before."""
    breaks = np.flatnonzero(data == LINE_BREAK) + 1
    starts = np.unique(np.concatenate((bounds[:-1][np.diff(bounds) > 0], breaks[breaks < data.size])))
    texts = np.searchsorted(starts, bounds)
    return np.append(starts, data.size), np.diff(texts)


def sorted_sets(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of every line in order, all in one array, and how many each line has."""
    parts, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for low in range(0, first.size - 1, 1 << (64 - BITS)):
        bounds = first[low : low + (1 << (64 - BITS)) + 1]
        line = np.repeat(np.arange(bounds.size - 1, dtype=np.uint64) << np.uint64(BITS), np.diff(bounds))
        keys = distinct(line | tokens[bounds[0] : bounds[-1]])
        parts.append(keys & np.uint64((1 << BITS) - 1))
        sizes.append(np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=bounds.size - 1))
    return np.concatenate(parts), np.concatenate(sizes)


def per_line(values: np.ndarray, sizes: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """The values of each line combined; 0 for a line without any."""
    out = np.zeros(sizes.size, np.uint64)
    some = np.flatnonzero(sizes)
    if some.size:
        out[some] = combine.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each line's set, whatever the order of its tokens."""
    return mix(per_line(mix(tokens), sizes, np.add) ^ sizes.astype(np.uint64)).view(np.int64)


def sketches(places: np.ndarray, sizes: np.ndarray, numbers: int) -> list[np.ndarray]:
    """How many words of each line fall into each place, modulo 16, as numbers of `PLACES` counts."""
    width = numbers * PLACES
    line = np.repeat(np.arange(sizes.size) * width, sizes)
    counts = np.bincount(line + places.astype(np.int64), minlength=sizes.size * width).astype(np.uint64) & np.uint64(15)
    packed = counts.reshape(-1, PLACES) << (np.arange(PLACES, dtype=np.uint64) * np.uint64(4))
    return list(np.bitwise_or.reduce(packed, axis=1).view(np.int64).reshape(sizes.size, numbers).T.copy())


def apart(names: tuple[str, ...]) -> Column:
    """By how much the sketches in the columns a_<name> and b_<name> differ: never more than the sets differ in words.

    Every byte of a number holds one of two neighbouring counts at a time, so no step carries into the next byte."""

    def each_byte(value: int) -> Column:
        return F.lit(value * 0x0101010101010101)

    differing = F.lit(0).cast("long")
    for name in names:
        halves = F.lit(0).cast("long")
        for shift in (0, 4):
            a, b = (F.shiftrightunsigned(F.col(f"{side}_{name}"), shift).bitwiseAND(each_byte(15)) for side in "ab")
            step = (a.bitwiseOR(each_byte(16)) - b).bitwiseAND(each_byte(15))
            negative = F.shiftright(step, 3).bitwiseAND(each_byte(1))
            halves = halves + step.bitwiseXOR(negative * 15) + negative
        differing = differing + halves % 255  # the sum of its bytes, which are 16 at most
    return differing


class Lines:
    """The lines of a batch of texts: word hashes, where each line's begin, its text's number and its number there."""

    def __init__(self, hashed: Words, texts: pa.Array) -> None:
        data, bounds = raw_bytes(texts)
        lines, many = line_bounds(data, bounds)
        self.words, self.first = hashed(data, lines)
        self.tokens = self.words >> np.uint64(64 - BITS)
        self.text = np.repeat(np.arange(many.size), many)
        self.line = np.arange(self.text.size) - np.repeat(np.cumsum(many) - many, many)


def all_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, k, line and set of every line that takes part, with times: how many lines of its batch have its set at the
    first of them, 0 at others. Besides, a row for each task that has only counts: how many words of all its lines fall
    into each hash bucket. The texts are read once for both."""

    names = ["doc_id", "k", "line", "set", "times", "counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Words(), np.zeros(RARITY, np.int64)
        for batch in small_batches(batches, 0):
            lines = Lines(hashed, batch.column(0))
            total += np.bincount((lines.tokens % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
            tokens, sizes = sorted_sets(lines.tokens, lines.first)
            keep = np.flatnonzero(sizes >= max(least_words, 1))
            text = pa.array(lines.text[keep])
            marks = set_hashes(tokens, sizes)[keep]
            ids = batch.column(1).fill_null(2**63 - 1).to_numpy()[lines.text[keep]]
            order = ranking_of(marks, lines.line[keep], batch.column(2).to_numpy()[lines.text[keep]], ids)
            begins = np.flatnonzero(np.append(True, np.diff(marks[order]) != 0)[: keep.size])
            times = np.zeros(keep.size, np.int64)
            times[order[begins]] = np.diff(np.append(begins, keep.size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(text),
                    batch.column(2).take(text),
                    pa.array(lines.line[keep].astype(np.int32)),
                    pa.array(marks),
                    pa.array(times),
                    pa.nulls(keep.size, pa.list_(pa.int64())),
                ],
                names,
            )
        ends = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        all_counts = pa.ListArray.from_arrays(pa.array([0, RARITY], pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([*ends, all_counts], names)

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("k"))
    return rows.mapInArrow(cut, "doc_id long, k long, line int, set long, times long, counts array<long>")


def rarity(noted: DataFrame) -> np.ndarray:
    """How many words fall into each hash bucket, from the counts of each task; the table's size is fixed."""
    counts = np.zeros(RARITY, np.int64)
    rows = noted.filter("set is null").select(F.posexplode("counts").alias("bucket", "n")).filter("n > 0")
    rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def dealt(entries: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows of entries by range of words, each field's values side by side."""
    where = (mix(entries["token"].view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(cuts))
    fields = [entries[name][order] for name in ENTRY.names]
    parts = [b"".join([field[cuts[one] : cuts[one + 1]].tobytes() for field in fields]) for one in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["part", "entries"])


def undealt(blob: bytes) -> np.ndarray:
    entries, place = np.empty(len(blob) // ENTRY.itemsize, ENTRY), 0
    for name in ENTRY.names:
        entries[name] = np.frombuffer(blob, ENTRY[name], entries.size, place)
        place += entries.size * ENTRY[name].itemsize
    return entries


def filed(docs: DataFrame, counts: np.ndarray, percent: int, least_words: int, ranges: int) -> DataFrame:
    """An entry for each set and prefix word, packed by range of words.

    Sets that can only be like their copies have no entry: of n words at best n are shared with a set of n + 1."""
    by_rarity = np.argsort(counts, kind="stable").astype(np.uint64)
    rank = np.empty(RARITY, np.uint64)
    rank[by_rarity] = np.arange(RARITY, dtype=np.uint64)
    bucket_bits = RARITY.bit_length() - 1
    rest_bits = np.uint64(BITS - bucket_bits)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seen, waiting, size = Words(), {}, [], 0
        for batch in small_batches(batches, 0):
            lines = Lines(hashed, batch.column(0))
            places = rank[lines.tokens % np.uint64(RARITY)] << rest_bits | lines.tokens >> np.uint64(bucket_bits)
            places, sizes = sorted_sets(places, lines.first)
            rest = places & ((np.uint64(1) << rest_bits) - np.uint64(1))
            tokens = rest << np.uint64(bucket_bits) | by_rarity[places >> rest_bits]
            marks = set_hashes(tokens, sizes)
            (sketch,) = sketches(tokens >> np.uint64(BITS - 4), sizes, 1)
            taking = np.flatnonzero((sizes >= max(least_words, 1)) & (sizes * 100 >= (sizes + 1) * percent))
            ids, chosen = batch.column(1).to_numpy()[lines.text[taking]].tolist(), []
            for number, mark, doc_id in zip(taking.tolist(), marks[taking].tolist(), ids):
                if mark not in seen or doc_id < seen[mark]:
                    seen[mark] = doc_id
                    chosen.append(number)
            if len(seen) > SEEN:
                seen = {}
            chosen = np.array(chosen, np.int64)
            n = sizes[chosen]
            length = n - -(-n * percent // 100) + 1
            of = np.repeat(chosen, length)
            pos = np.arange(of.size) - np.repeat(np.cumsum(length) - length, length)
            entries = np.empty(of.size, ENTRY)
            entries["token"] = places[(np.cumsum(sizes) - sizes)[of] + pos].view(np.int64)
            entries["set"], entries["sketch"], entries["n"], entries["pos"] = marks[of], sketch[of], sizes[of], pos
            entries["doc_id"] = batch.column(1).to_numpy()[lines.text[of]]
            waiting.append(entries)
            size += entries.size
            if size > WAITING:
                yield dealt(np.concatenate(waiting), ranges)
                waiting, size = [], 0
        if size:
            yield dealt(np.concatenate(waiting), ranges)

    rows = docs.select("text", last_if_null("doc_id").alias("doc_id"))
    return rows.mapInArrow(prefixes, "part int, entries binary")


def sketches_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What `apart` says of sketches of one number."""
    each = np.uint64(0x0101010101010101)
    differing = np.zeros(a.size, np.int64)
    for shift in (0, 4):
        one, two = (side >> np.uint64(shift) & each * np.uint64(15) for side in (a.view(np.uint64), b.view(np.uint64)))
        step = ((one | each * np.uint64(16)) - two) & each * np.uint64(15)
        negative = step >> np.uint64(3) & each
        differing += (((step ^ negative * np.uint64(15)) + negative) % np.uint64(255)).astype(np.int64)
    return differing


def with_candidates(entries: np.ndarray, percent: int) -> np.ndarray:
    """Each set once under a word, with its smallest doc_id, if another set under that word passes the filters with it.

    Under a word the sets stand by size, so each meets the next ones as long as their sizes allow the overlap."""
    token_and_size = entries["token"] << (64 - 1 - BITS) | np.minimum(entries["n"], (1 << (64 - 1 - BITS)) - 1)
    entries = entries.take(ranking_of(token_and_size, entries["doc_id"], entries["set"], entries["n"]))
    if entries.size < 2:
        return entries[:0]
    fresh = np.ones(entries.size, bool)
    fresh[1:] = (entries["token"][1:] != entries["token"][:-1]) | (entries["set"][1:] != entries["set"][:-1])
    entries = entries.take(np.flatnonzero(fresh))
    token, marks, sketch, n, pos = (entries[name].copy() for name in ("token", "set", "sketch", "n", "pos"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    group = np.repeat(np.arange(begins.size), np.diff(np.append(begins, token.size)))
    found = np.zeros(token.size, bool)
    at, ahead = np.flatnonzero(n - pos >= -(-2 * n * percent // (100 + percent))), 1
    while at.size:
        if ahead & (ahead - 1) == 0:  # now and then: groups all of which are found need no more pairs
            at = at[~np.logical_and.reduceat(found, begins)[group[at]]]
        at = at[at + ahead < token.size]
        other = at + ahead
        near = (token[at] == token[other]) & (n[at] * 100 >= n[other] * percent)
        at, other = at[near], other[near]
        total = n[at] + n[other]
        overlap = -(-total * percent // (100 + percent))
        good = np.flatnonzero((np.minimum(n[at] - pos[at], n[other] - pos[other]) >= overlap) & ~(found[at] & found[other]))
        a, b = at[good], other[good]
        good = (sketches_apart(sketch[a], sketch[b]) <= total[good] - 2 * overlap[good]) & (marks[a] != marks[b])
        found[a[good]] = found[b[good]] = True
        ahead += 1
    return entries.take(np.flatnonzero(found))


def store_by_token(parts: DataFrame, percent: int, spark: SparkSession) -> str:
    """The name of a table with a row for each token and set that has a candidate there, in buckets of tokens, so joins
    on it need no shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> pa.RecordBatch:
            entries = with_candidates(np.concatenate(waiting), percent)
            return pa.RecordBatch.from_arrays([pa.array(entries[name].copy()) for name in ENTRY.names], list(ENTRY.names))

        part, waiting = None, []
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if waiting and number != part:
                    yield kept()
                    waiting = []
                part = number
                waiting.append(undealt(blob.as_py()))
        if waiting:
            yield kept()

    ranges = parts.repartitionById(buckets, F.col("part") % buckets).sortWithinPartitions("part")
    rows = ranges.mapInArrow(compare, "token long, set long, sketch long, doc_id long, n int, pos int")
    return bucketed(rows.repartition(buckets, "token"), "line_prefixes", buckets, ["token"])


def candidates(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets a, b that may be alike, a in no later document, from rows with equal token; tie: in the same."""
    left = one.select("token", *[F.col(name).alias(f"a_{name}") for name in ("set", "n", "pos", "sketch", "doc_id")])
    right = two.select("token", *[F.col(name).alias(f"b_{name}") for name in ("set", "n", "pos", "sketch", "doc_id")])
    total = F.col("a_n") + F.col("b_n")
    overlap = F.ceil(total * percent / (100 + percent))
    left_over = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    good = (
        (F.col("a_set") != F.col("b_set"))
        & (F.col("a_doc_id") <= F.col("b_doc_id"))
        & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
        & (left_over >= overlap)
        & (apart(("sketch",)) <= total - 2 * overlap)
    )
    tie = (F.col("a_doc_id") == F.col("b_doc_id")).alias("tie")
    return left.join(right, "token").filter(good).select(F.col("a_set").alias("a"), F.col("b_set").alias("b"), tie)


def marked(sets: DataFrame) -> np.ndarray:
    """A bit for each slot that one of the sets falls into, as a table of fixed size: what it lets pass is joined by set."""
    slot = F.expr(f"`set` & {MARKS - 1}L")
    rows = sets.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(`set` & 63L as int))").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(MARKS // 64, np.uint64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def full_sets(docs: DataFrame, some: DataFrame) -> DataFrame:
    """set, words and wide sketch of some sets at least, from the texts."""
    wanted = marked(some)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seen = Words(), set()
        for batch in small_batches(batches, 0):
            lines = Lines(hashed, batch.column(0))
            marks = set_hashes(*sorted_sets(lines.tokens, lines.first))
            slots = marks.view(np.uint64) % np.uint64(MARKS)
            there = wanted[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)
            there &= np.diff(lines.first) > 0
            values, chosen = [np.empty(0, np.uint64)], []
            for number in np.flatnonzero(there).tolist():
                mark = int(marks[number])
                if mark not in seen:
                    seen.add(mark)
                    chosen.append(mark)
                    values.append(distinct(lines.words[lines.first[number] : lines.first[number + 1]]))
            if len(seen) > SEEN:
                seen = set()
            many = np.array([one.size for one in values])
            flat = np.concatenate(values)
            words = pa.ListArray.from_arrays(np.cumsum(many).astype(np.int32), flat.view(np.int64))
            wide = sketches(flat & np.uint64(len(WIDE) * PLACES - 1), many[1:], len(WIDE))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.int64()), words, *(pa.array(part) for part in wide)], ["set", "words", *WIDE]
            )

    schema = ", ".join(["set long", "words array<long>", *(f"{name} long" for name in WIDE)])
    return written(docs.select("text").mapInArrow(sets, schema).dropDuplicates(["set"]), "sets")


def verified(pairs: DataFrame, first: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b (tie: first found in one document) those that are alike, a before b: the sets b."""
    pairs = written(pairs.distinct(), "pairs")
    at = [first.select(F.col("set").alias(side), F.col("place").alias(f"{side}_place")) for side in "ab"]
    ties = pairs.filter("tie").join(at[0], "a").join(at[1], "b").filter("a_place < b_place").select("a", "b")
    ordered = written(pairs.filter("not tie").select("a", "b").union(ties), "ordered")
    sides = [
        held.select(F.col("set").alias(side), F.size("words").alias(f"{side}_n"), *[F.col(name).alias(f"{side}_{name}") for name in WIDE])
        for side in "ab"
    ]
    total = F.col("a_n") + F.col("b_n")
    overlap = F.ceil(total * percent / (100 + percent))
    likely = ordered.join(sides[0], "a").join(sides[1], "b").filter(apart(WIDE) <= total - 2 * overlap).select("a", "b")
    likely = written(likely, "likely")
    full = held.select("set", "words")
    both = likely.join(full.toDF("a", "one"), "a").join(full.toDF("b", "two"), "b")
    same = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - same
    return both.filter(same * 100 >= union * percent).select(F.col("b").alias("set")).distinct()


def repeated_lines(docs: DataFrame, percent: int = 80, least_words: int = 3) -> DataFrame:
    """k and line of every line to be removed, once."""
    spark = docs.sparkSession
    noted = written(all_lines(docs, least_words), "lines")
    lines = noted.filter("set is not null").drop("times", "counts")
    place = F.struct(last_if_null("doc_id").alias("doc_id"), "k", "line")
    firsts = noted.filter("times > 0").repartition("set")  # however common a line, at most one for each batch of texts
    first = written(firsts.groupBy("set").agg(F.min(place).alias("place"), F.sum("times").alias("many")), "first")

    ranges = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = store_by_token(filed(docs, rarity(noted), percent, least_words, ranges), percent, spark)
    rows = spark.table(stored)
    held = full_sets(docs, rows.select("set"))
    entry = F.struct("doc_id", "set", "n", "pos", "sketch")
    leaders = rows.groupBy("token").agg(F.min(entry).alias("lead"), F.count("*").alias("many")).filter("many > 1")
    leaders = leaders.select("token", "lead.*")
    removed = written(verified(both_ways(candidates(leaders, rows, percent)), first, held, percent), "removed")
    left = rows.join(bounded(removed), "set", "left_anti")
    more = verified(candidates(rows, left, percent), first, held, percent)
    removed = written(removed.union(more).distinct().withColumn("alike", F.lit(True)), "removed")
    known = first.join(removed, "set", "left").filter("many > 1 or alike").withColumnRenamed("place", "first_place")
    known = written(known, "known")  # only lines of these sets can go: few where most lines are like no other
    later = lines.join(known, "set").filter(F.col("alike") | (place != F.col("first_place"))).select("k", "line").distinct()
    later = written(later, "repeated")
    unbucketed(spark, stored)
    return later


def both_ways(pairs: DataFrame) -> DataFrame:
    """Where both are first found in one document, either may come first."""
    one, other = F.struct("a", "b", "tie"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "tie")
    return pairs.select(F.explode(F.when(F.col("tie"), F.array(one, other)).otherwise(F.array(one))).alias("pair")).select("pair.*")


def bounded(rows: DataFrame) -> DataFrame:
    """Rows of one number each, broadcast where there are at most `BROADCAST_ROWS`; an ordinary join side beyond."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """All columns of the documents with `_kept` (text without the lines), `_lines` and `_removed` (numbers)."""
    lists = lines.groupBy("k").agg(F.collect_set("line").alias("_gone"))
    cut = F.split("text", "\n", -1)
    kept = F.filter(cut, lambda _, number: ~F.array_contains("_gone", number))
    return (
        docs.withColumn("_k", document_key())
        .join(lists.withColumnRenamed("k", "_k"), "_k", "left")
        .withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("_lines", F.coalesce(F.size(F.filter(cut, lambda line: line != "")), F.lit(0)))
        .withColumn("_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")))
        .drop("_gone", "_k")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (not empty), n_removed and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = without_lines(docs, repeated_lines(docs, least_words=1))
    digest = F.sha2(F.coalesce("_kept", F.lit("")), 256)
    return found.select(
        "doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), digest.alias("kept_sha256")
    )
