"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of `WINDOW` bytes, forwards and backwards, gives every position of the whole
text a probability for each language, and the document the mean over its positions that belong to letters. It is
trained here with NumPy by backpropagation through time, on the driver, from windows of at most `SAMPLE` labelled
documents, an equal share for each language; A-Z are read as a-z.

Defined results: a text that is null or holds no letter is `und` with score 0; so is every text if there is nothing
to learn from. Repeated rows are judged each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from jumptrail.llm.samples import SPAN
from jumptrail.llm.text_arrays import raw_bytes, small_batches
from jumptrail.shared import written

SAMPLE = 3000
SAMPLE_WINDOWS = 6
TRAIN_WINDOW = 48
HIDDEN = 12
STEPS = 300
BATCH = 192
WINDOW = 256
TOGETHER = 2048  # windows that advance together
UNDETERMINED = "und"


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def gate(value: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return 0.5 + 0.5 * np.tanh(0.5 * value)


class Network:
    """Weights by name: for either direction the input table, the recurrent matrix and bias, and the output."""

    def __init__(self, languages: list[str], seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {"out": np.zeros(len(languages), np.float32)}
        for way in ("f", "b"):
            for name, shape in (
                ("in", (3 * HIDDEN, 256)),
                ("re", (3 * HIDDEN, HIDDEN)),
                ("to", (len(languages), HIDDEN)),
            ):
                self.weights[way + name] = (random.standard_normal(shape) * 0.3).astype(np.float32)
            self.weights[way + "bias"] = np.zeros((3 * HIDDEN, 1), np.float32)

    def run(self, way: str, data: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """What one direction adds to the score of each language at each position; data is positions by windows."""
        w = self.weights
        table, turn, to = w[way + "in"] + w[way + "bias"], w[way + "re"], w[way + "to"]
        positions, windows = data.shape
        scores = np.empty((positions, to.shape[0], windows), np.float32)
        state = np.zeros((HIDDEN, windows), np.float32)
        h = HIDDEN
        for at in range(positions) if way == "f" else range(positions - 1, -1, -1):
            x = np.take(table, data[at], axis=1)
            y = turn @ state
            gates = gate(x[: 2 * h] + y[: 2 * h])
            update, reset = gates[:h], gates[h:]
            new = np.tanh(x[2 * h :] + reset * y[2 * h :])
            after = new + update * (state - new)
            if mask is not None:
                after *= mask[at]
            if keep is not None:
                keep.append((at, state, update, reset, new, y[2 * h :]))
            state = after
            np.matmul(to, state, out=scores[at])
        return scores

    def probabilities(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Positions by languages by windows."""
        scores = self.run("f", data, mask)
        scores += self.run("b", data, mask)
        scores += self.weights["out"][:, None]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        kept: dict[str, list] = {"f": [], "b": []}
        scores = self.run("f", data, None, kept["f"]) + self.run("b", data, None, kept["b"])
        scores += self.weights["out"][:, None]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True)
        error[:, labels, np.arange(labels.size)] -= 1.0
        error *= (weight / (weight.sum() * data.shape[0])).astype(np.float32)
        grads = {"out": error.sum(axis=(0, 2))}
        for way in ("f", "b"):
            grads |= self.back(way, data, error, kept[way])
        return grads

    def back(self, way: str, data: np.ndarray, error: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        """Backpropagation through time for one direction."""
        turn, to = self.weights[way + "re"], self.weights[way + "to"]
        d_turn, d_to = np.zeros_like(turn), np.zeros_like(to)
        d_in = np.zeros((3 * HIDDEN, 256), np.float32)
        carried = np.zeros((HIDDEN, data.shape[1]), np.float32)
        for at, state, update, reset, new, y in reversed(kept):
            after = new + update * (state - new)
            d_to += error[at] @ after.T
            d_after = carried + to.T @ error[at]
            d_update = d_after * (state - new) * update * (1 - update)
            d_new = d_after * (1 - update) * (1 - new * new)
            d_reset = d_new * y * reset * (1 - reset)
            through = np.concatenate((d_update, d_reset, d_new * reset))
            d_turn += through @ state.T
            carried = d_after * update + turn.T @ through
            entering = np.concatenate((d_update, d_reset, d_new))
            for row in range(3 * HIDDEN):
                d_in[row] += np.bincount(data[at], entering[row], 256).astype(np.float32)
        return {
            way + "in": d_in,
            way + "bias": d_in.sum(axis=1, keepdims=True),
            way + "re": d_turn,
            way + "to": d_to,
        }

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 5) -> None:
        """Adam over random batches; every language weighs the same."""
        random = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(self.languages))
        weight = (labels.size / np.maximum(counts, 1) / len(counts))[labels]
        mean = {name: np.zeros_like(value) for name, value in self.weights.items()}
        square = {name: np.zeros_like(value) for name, value in self.weights.items()}
        for step in range(1, STEPS + 1):
            rows = random.integers(0, labels.size, BATCH)
            grads = self.gradients(np.ascontiguousarray(windows[rows].T), labels[rows], weight[rows])
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
            for name, grad in grads.items():
                mean[name] = 0.9 * mean[name] + 0.1 * grad
                square[name] = 0.99 * square[name] + 0.01 * grad * grad
                moved = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                self.weights[name] -= (rate * moved).astype(np.float32)

    def documents(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text over the positions of letters (all zero without one)."""
        data = folded(data)
        letter = ((data >= 97) & (data <= 122)) | (data >= 128)
        pooled = np.zeros((bounds.size - 1, len(self.languages)))
        counted = np.zeros(bounds.size - 1)
        sizes = np.diff(bounds)
        many = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(sizes.size), many)
        number = np.arange(owner.size) - np.repeat(np.cumsum(many) - many, many)
        start = bounds[owner] + number * WINDOW
        length = np.minimum(WINDOW, bounds[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        for first in range(0, order.size, TOGETHER):
            rows = order[first : first + TOGETHER]
            longest = int(length[rows[0]])
            at = start[rows][None, :] + np.arange(longest)[:, None]
            inside = np.arange(longest)[:, None] < length[rows][None, :]
            at = np.where(inside, at, 0)
            found = self.probabilities(data[at], None if inside.all() else inside.astype(np.float32))
            counts = (inside & letter[at]).astype(np.float32)
            total = np.einsum("tcw,tw->wc", found, counts)
            np.add.at(pooled, owner[rows], total)
            np.add.at(counted, owner[rows], counts.sum(axis=0))
        return pooled / np.maximum(counted, 1)[:, None]

    def positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        data = folded(np.frombuffer(text.encode(), np.uint8))
        found = []
        for start in range(0, data.size, WINDOW):
            best = self.probabilities(data[start : start + WINDOW, None])[:, :, 0].argmax(axis=1)
            found += [self.languages[number] for number in best]
        return found


def is_held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def chosen_documents(labelled: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang): an equal share of the sample for each language, those whose ids have the smallest hashes.

    A language of few documents has them all, so none goes missing beside a large one; an id counts once, however
    many rows it has."""
    ids = written(labelled.groupBy("lang", "doc_id").agg(F.pmod(F.xxhash64("doc_id"), F.lit(SPAN)).alias("rank")).filter("rank is not null"), "ids")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    share = max(1, sample // max(1, counts.count()))
    # About twice the share is left of a language before its rows meet.
    thinned = ids.join(F.broadcast(counts), "lang").filter(F.col("rank") <= F.lit(float(2 * share * SPAN)) / F.col("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))
    return thinned.select("lang", "doc_id", place.alias("place")).filter(F.col("place") <= share).drop("place")


def others(pieces: np.ndarray, seed: int = 17) -> np.ndarray:
    """Windows that are no language of the sample: the same bytes shuffled, random letters, letters of other scripts."""
    random = np.random.default_rng(seed)
    mixed = random.permuted(pieces, axis=1)
    third = len(pieces) // 3 + 1
    letters = random.integers(97, 123, (third, TRAIN_WINDOW)).astype(np.uint8)
    letters[random.random(letters.shape) < 0.15] = 32
    foreign = np.empty((third, TRAIN_WINDOW), np.uint8)
    for row in foreign:
        # A script: a stretch of code points; two or three bytes each.
        first = int(random.integers(0x370, 0x9F00))
        points = first + random.integers(0, int(random.choice([48, 96, 2000])), TRAIN_WINDOW)
        text = "".join(" " if random.random() < 0.12 else chr(point) for point in points)
        row[:] = np.frombuffer(text.encode("utf-8", "ignore").ljust(TRAIN_WINDOW)[:TRAIN_WINDOW], np.uint8)
    return np.concatenate([mixed[:third], letters, foreign])


def fit(docs: DataFrame, sample: int = SAMPLE, rejecting: bool = False) -> Network | None:
    """Train on labelled documents that are not held out; null ids count as held out.

    A rejecting network has one class more, UNDETERMINED, taught from windows that are none of the languages."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, cut = [], []
            for doc_id, text, lang in zip(*(column.to_pylist() for column in batch.columns)):
                data = text.encode()
                random = np.random.default_rng(abs(doc_id))
                for start in random.integers(0, max(1, len(data) - TRAIN_WINDOW + 1), SAMPLE_WINDOWS):
                    piece = data[start : start + TRAIN_WINDOW]
                    langs.append(lang)
                    cut.append(piece.ljust(TRAIN_WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], ["lang", "piece"])

    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), 3, 1) & (F.length("text") > 0)
    )
    chosen = chosen_documents(labelled, sample)
    # At most `sample` rows are broadcast; where an id has several texts of a language, one of them is taken.
    rows = (
        labelled.join(F.broadcast(chosen), ["lang", "doc_id"])
        .groupBy("lang", "doc_id")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("doc_id", "text", "lang")
        .mapInArrow(windows, "lang string, piece binary")
        .orderBy("lang", "piece")
        .toArrow()
    )
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return None
    pieces = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8).reshape(-1, TRAIN_WINDOW)
    labels = np.array([languages.index(lang) for lang in langs])
    if rejecting:
        strange = others(pieces)
        pieces = np.concatenate([pieces, strange])
        labels = np.concatenate([labels, np.full(len(strange), len(languages))])
        languages = [*languages, UNDETERMINED]
    network = Network(languages)
    network.train(folded(pieces), labels)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of the documents, with lang_pred and score."""
    names = docs.columns
    place = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, place):
            data, bounds = raw_bytes(batch.column(place))
            found = network.documents(data, bounds) if network else np.zeros((batch.num_rows, 1))
            best = found.argmax(axis=1)
            lettered = [any(map(str.isalpha, text.as_py() or "")) for text in batch.column(place)]
            known = np.array(lettered, bool) & (network is not None)
            langs = [network.languages[number] if ok else UNDETERMINED for number, ok in zip(best, known)]
            score = np.clip(np.where(known, found[np.arange(best.size), best], 0.0), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *more]))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
