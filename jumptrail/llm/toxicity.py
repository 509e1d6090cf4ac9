"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are counted over Arrow batches as byte arrays: densities of a given lexicon and of a learned one (plain, and
after undoing letters written as signs), lexicon words near a second person, rates of capitals, exclamation marks,
other punctuation, digits and obfuscated words. Fitting takes at most `SAMPLE` labelled documents, parted by hash:
half gives the learned lexicon (words and beginnings of words that far more toxic documents have than others, by
their hashes), a third grows the trees, and the rest calibrates their output by isotonic regression.

Defined results: a null text is an empty one; it is scored from features that are all zero. Without labels of both
kinds every score is the share of toxic labels (0 without labels). Labels that are null or of null ids teach
nothing; an id with several labels counts as toxic if one says so. Repeated rows are scored each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from jumptrail.llm.language import is_held_out
from jumptrail.llm.samples import bounded_sample
from jumptrail.llm.text_arrays import Words, byte_codes, distinct, raw_bytes, shingles, small_batches
from jumptrail.shared import written

SAMPLE = 12_000
LEARNED = 400  # hashes of the learned lexicon, at most
BEGINNINGS = (4, 5, 6, 8)  # bytes
THRESHOLD = 0.3

LEXICON = (
    "idiot moron stupid dumb trash garbage scum loser pathetic worthless disgusting clown fool imbecile vermin "
    "filth ugly hate kill shut"
).split()

SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus vosotros usted ustedes"
).split()

NEAR = 5  # words

# Signs that stand for letters in obfuscated words.
STANDS_FOR = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

FEATURES = 15
MOST = np.uint64(2**64 - 1)


def letters_only() -> np.ndarray:
    """Bytes that part words of letters: all ASCII but letters."""
    apart = np.ones(256, bool)
    apart[65:91] = apart[97:123] = apart[128:] = False
    return apart


class Features:
    """Rows of numbers for texts; one object serves all batches of a task."""

    def __init__(self, learned: list[int]) -> None:
        self.plain = Words(apart=letters_only())
        apart, codes = letters_only(), byte_codes(True)
        for sign, letter in STANDS_FOR.items():
            apart[ord(sign)] = False
            codes[ord(sign)] = codes[ord(letter)]
        self.undone = Words(apart=apart)
        self.undone.codes = codes
        self.lexicon = self.hashes(LEXICON)
        self.learned = distinct(np.array(learned, np.int64).view(np.uint64))
        self.second = self.hashes(SECOND_PERSON)
        self.sign = np.zeros(256, bool)
        self.sign[[ord(sign) for sign in STANDS_FOR]] = True

    def hashes(self, words: list[str]) -> np.ndarray:
        data, bounds = raw_bytes(pa.array(words, pa.string()))
        return distinct(self.plain(data, bounds)[0])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, bounds = raw_bytes(texts)
        size = np.diff(bounds)
        words, first = self.plain.with_beginnings(data, bounds, BEGINNINGS)
        undone, undone_first = self.undone.with_beginnings(data, bounds, BEGINNINGS)
        many = np.maximum(np.diff(first), 1)
        in_given, in_learned = is_in(words[0], self.lexicon), is_in(words, self.learned).any(axis=0)
        given, learned = self.per_text(in_given, first), self.per_text(in_learned, first)
        hidden = self.per_text(is_in(undone[0], self.lexicon), undone_first)
        hidden_learned = self.per_text(is_in(undone, self.learned).any(axis=0), undone_first)
        near = self.near_second(in_given | in_learned, is_in(words[0], self.second), first)
        length = np.maximum(size, 1)
        capitals = per_text_bytes((data >= 65) & (data <= 90), bounds)
        letters = np.maximum(per_text_bytes(~self.plain.apart[data], bounds), 1)
        marks = per_text_bytes(data == 33, bounds)
        punctuation = per_text_bytes((data > 32) & (data < 127) & self.plain.apart[data], bounds)
        digits = per_text_bytes((data >= 48) & (data <= 57), bounds)
        amid = self.sign[data[1:-1]] & ~self.plain.apart[data[:-2]] & ~self.plain.apart[data[2:]] if data.size > 2 else []
        masked = per_text_bytes(np.concatenate(([False], amid, [False]))[: data.size].astype(bool), bounds)
        columns = (
            np.log1p(given), given / many, np.log1p(learned), learned / many,
            np.log1p(np.maximum(hidden - given, 0)), np.maximum(hidden - given, 0) / many,
            np.log1p(np.maximum(hidden_learned - learned, 0)),
            np.log1p(near), near / many,
            capitals / letters, marks / length, punctuation / length, digits / length, masked / many, np.log1p(size),
        )
        return np.stack(columns, axis=1)

    @staticmethod
    def per_text(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hit)
        return np.diff(np.searchsorted(at, first)).astype(float)

    @staticmethod
    def near_second(hit: np.ndarray, person: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Lexicon words with a second person at most NEAR words away in the same text."""
        hits, persons = np.flatnonzero(hit), np.flatnonzero(person)
        text = np.searchsorted(first, hits, side="right") - 1
        low, high = np.maximum(hits - NEAR, first[text]), np.minimum(hits + NEAR + 1, first[text + 1])
        close = np.searchsorted(persons, high) > np.searchsorted(persons, low)
        return np.bincount(text[close], minlength=first.size - 1).astype(float)


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a small sorted table."""
    if not table.size:
        return np.zeros(values.shape, bool)
    return table[np.minimum(np.searchsorted(table, values), table.size - 1)] == values


def per_text_bytes(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), bounds)).astype(float)


class Trees:
    """Boosted trees for the logistic loss over features cut into bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def cut(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, column, side="right") for edges, column in zip(self.edges, rows.T)], axis=1)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins)[1:-1])) for column in rows.T]
        cut = self.cut(rows)
        share = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        output = np.full(len(rows), self.start)
        self.trees = []
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-output))
            tree = self.grow(cut, labels - chance, chance * (1 - chance))
            self.trees.append(tree)
            output += self.walk(tree, cut)

    def grow(self, cut: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple:
        """Feature, bin and value of every node of a full tree, numbered level by level."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, split, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(cut), int)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            total, weight = slope[here].sum(), bend[here].sum()
            value[node] = self.rate * total / (weight + 1.0)
            if 2 * node + 2 >= nodes or here.size < 20:
                continue
            best = 1e-3
            for number in range(cut.shape[1]):
                left = np.cumsum(np.bincount(cut[here, number], slope[here], self.bins))[:-1]
                held = np.cumsum(np.bincount(cut[here, number], bend[here], self.bins))[:-1]
                gain = left**2 / (held + 1) + (total - left) ** 2 / (weight - held + 1) - total**2 / (weight + 1)
                place = int(gain.argmax())
                if gain[place] > best:
                    best, feature[node], split[node] = gain[place], number, place
            if feature[node] >= 0:
                at[here] = 2 * node + 1 + (cut[here, feature[node]] > split[node])
        return feature, split, value

    def walk(self, tree: tuple, cut: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        at = np.zeros(len(cut), int)
        for _ in range(self.depth):
            chosen = feature[at]
            inner = chosen >= 0
            right = cut[np.arange(len(cut)), np.maximum(chosen, 0)] > split[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def output(self, rows: np.ndarray) -> np.ndarray:
        cut = self.cut(rows)
        return self.start + sum(self.walk(tree, cut) for tree in self.trees)


class Isotonic:
    """A rising line through the shares of neighbouring outputs, pooled until they rise.

    Equal outputs are one pool from the start, so their order does not matter; shares are smoothed before they are
    compared, so the line never falls."""

    def __init__(self, outputs: np.ndarray, labels: np.ndarray) -> None:
        values, first, each = np.unique(outputs, return_inverse=True, return_counts=True)
        toxic = np.bincount(first, weights=labels, minlength=values.size)
        pools: list[tuple[float, float, float]] = []
        for x, y, n in zip(values * each, toxic, each):
            while pools and self.share(*pools[-1][1:]) >= self.share(y, n):
                before = pools.pop()
                x, y, n = before[0] + x, before[1] + y, before[2] + n
            pools.append((x, y, n))
        self.x = np.array([x / n for x, _, n in pools])
        self.y = np.array([self.share(y, n) for _, y, n in pools])

    @staticmethod
    def share(y: float, n: float) -> float:
        return (y + 0.02) / (n + 0.2)

    def __call__(self, outputs: np.ndarray) -> np.ndarray:
        return np.interp(outputs, self.x, self.y)


class Model:
    def __init__(self, learned: list[int], constant: float, trees: Trees | None = None, scale: Isotonic | None = None) -> None:
        self.learned, self.constant, self.trees, self.scale = learned, constant, trees, scale

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(rows):
            return np.full(len(rows), self.constant)
        return np.clip(self.scale(self.trees.output(rows)), 0.0, 1.0)


def learned_lexicon(docs: DataFrame) -> list[int]:
    """Hashes of words and beginnings that far more toxic documents have, by a smoothed log-odds ratio and its error."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Words(apart=letters_only())
        for batch in small_batches(batches, 0):
            words, first = plain.with_beginnings(*raw_bytes(batch.column(0)), BEGINNINGS)
            each = [distinct(words[:, a:b].ravel()) for a, b in zip(first, first[1:])]
            alike = [shingles(words[0, a:b], 3).min(initial=MOST).view(np.int64) for a, b in zip(first, first[1:])]
            ends = np.cumsum([0, *(found.size for found in each)]).astype(np.int32)
            found = pa.ListArray.from_arrays(ends, np.concatenate(each).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(alike, pa.int64()), found], ["doc_id", "toxic", "alike", "words"])

    # Copies of one text would make all its words look telling: one document for each smallest run of words.
    rows = docs.select("text", "doc_id", "toxic").mapInArrow(held, "doc_id long, toxic int, alike long, words array<long>")
    docs = rows.groupBy("alike").agg(F.min_by("toxic", "doc_id").alias("toxic"), F.min_by("words", "doc_id").alias("words"))
    totals = {row["toxic"]: row["count"] for row in docs.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counts = docs.select(F.explode("words").alias("word"), "toxic").filter("word <> 0").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = counts.filter((F.col("a") >= 5) & (odds > 2)).select("word", (odds / error).alias("z")).filter("z > 2.5")
    return [row["word"] for row in chosen.orderBy(F.desc("z"), "word").limit(LEARNED).collect()]


def featured(docs: DataFrame, learned: list[int], score: Model | None = None) -> DataFrame:
    """The columns of the documents but text, with their features, or with a score of them."""
    names = [name for name in docs.columns if name != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(learned)
        for batch in small_batches(batches, 0):
            rows = features(batch.column(0))
            if score:
                values = pa.array(score.score(rows))
            else:
                values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES, rows.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], [*names, "value"])

    given = docs.select("text", *names)
    value = StructField("value", DoubleType() if score else ArrayType(DoubleType()))
    return given.mapInArrow(compute, StructType([*given.schema.fields[1:], value]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels of documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"), 4, 2)
    )
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = bounded_sample(known, F.xxhash64("doc_id"), sample)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(12)).cast("int")
    # At most `sample` rows are broadcast; where an id has several texts, the one of the smallest hash is taught.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    taught = (
        texts.groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("text", "doc_id", "toxic", fold.alias("fold"))
    )
    taught = written(taught, "taught")
    learned = learned_lexicon(taught.filter("fold < 6"))
    rows = featured(taught.filter("fold >= 6"), learned).orderBy("doc_id").toArrow()
    toxic, part = rows.column("toxic").to_numpy(), rows.column("fold").to_numpy()
    constant = float(toxic.mean()) if toxic.size else 0.0
    numbers = rows.column("value").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    grown, scaled = part < 10, part >= 10
    if len(set(toxic[grown])) < 2 or len(set(toxic[scaled])) < 2:
        return Model(learned, constant)
    trees = Trees()
    trees.fit(numbers[grown], toxic[grown])
    return Model(learned, constant, trees, Isotonic(trees.output(numbers[scaled]), toxic[scaled]))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    found = featured(docs.select("doc_id", "text"), model.learned, model)
    return found.select(
        "doc_id", F.col("value").alias("score"), (F.col("value") >= threshold).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
