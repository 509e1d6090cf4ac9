"""Held-out accuracy of the trained models, and the stages of the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from jumptrail.llm import language, toxicity
from jumptrail.llm.text_arrays import Words, raw_bytes

TABLES = "/root/testdata/sf0.01"


def test_words_are_those_of_plain_python(monkeypatch):
    texts = ["", None, "one two", "  Two\tONE ", "é" * 40, "a" * 100 + " b", "\n", "x y z " * 50]
    monkeypatch.setattr("jumptrail.llm.text_arrays.SLICE", 16)
    hashes, first = Words()(*raw_bytes(pa.array(texts)))
    named: dict[bytes, int] = {}
    for text, a, b in zip(texts, first, first[1:]):
        words = (text or "").encode().lower().split()
        assert len(words) == b - a
        for word, value in zip(words, hashes[a:b].tolist()):
            assert named.setdefault(word, value) == value
    assert len(set(named.values())) == len(named)


def test_gradients_are_those_of_differences():
    network = language.Network(["a", "b", "c"])
    network.weights = {name: value.astype(np.float64) for name, value in network.weights.items()}
    random_ = np.random.default_rng(1)
    data, labels, weight = random_.integers(97, 101, (6, 5)), np.array([0, 1, 2, 1, 0]), np.ones(5)
    grads = network.gradients(data, labels, weight)

    def loss():
        chance = network.probabilities(data)
        return -np.log(chance[:, labels, np.arange(5)]).mean()

    for name, at in (("fre", (3, 4)), ("bin", (5, 98)), ("fto", (1, 2)), ("out", (1,)), ("bbias", (20, 0))):
        network.weights[name][at] += 1e-2
        high = loss()
        network.weights[name][at] -= 2e-2
        low = loss()
        network.weights[name][at] += 1e-2
        assert abs((high - low) / 2e-2 - grads[name][at]) < 2e-3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    network = language.fit(docs)
    assert len(network.positions("Où était")) == len("Où était".encode())
    found = language.identify(docs, network).toPandas()
    held = found[[zlib.crc32(str(n).encode()) % 3 == 1 for n in found.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (1, None), (None, "12 .. !"), (3, ""), (4, "the thing and the other " * 9000)], "doc_id long, text string")
    rows = language.identify(odd, network).collect()
    assert sorted(r.lang_pred for r in rows) == ["en", "und", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in language.identify(odd, language.fit(docs.limit(0))).collect()] == ["und"] * 5


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = toxicity.score_toxicity(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[[zlib.crc32(str(n).encode()) % 4 == 2 for n in found.doc_id]]
    assert held.predicted[held.toxic == 1].mean() > 0.85
    assert held.toxic[held.predicted == 1].mean() > 0.85
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "You st*pid 1d1ot! " * 3)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert {r.score for r in toxicity.score_toxicity(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_isotonic_scale_rises():
    random_ = np.random.default_rng(2)
    outputs = random_.standard_normal(300)
    scale = toxicity.Isotonic(outputs, (outputs + random_.standard_normal(300) > 0).astype(float))
    assert (np.diff(scale(np.linspace(-3, 3, 500))) >= 0).all()
    # A large pool of high scores beside a small one of the highest, and equal outputs in any order.
    outputs, labels = np.array([0.0] * 40 + [1.0] * 100 + [2.0]), np.array([0.0] * 40 + [1.0] * 95 + [0.0] * 5 + [1.0])
    scale = toxicity.Isotonic(outputs, labels)
    assert (np.diff(scale(np.linspace(-1, 3, 500))) >= 0).all()
    mixed = random_.permutation(outputs.size)
    assert (toxicity.Isotonic(outputs[mixed], labels[mixed])(outputs) == scale(outputs)).all()


def test_stages_keep_clean_documents_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    more = [(9001, text), (9002, "12 34 !!"), (9003, f"{text} and more {item}"), (9004, None)]
    extra = spark.createDataFrame([(a, b, None, "s", 1) for a, b in more], docs.schema)
    docs = docs.union(extra).selectExpr("*", "1 AS k", "2 AS score", "3 AS kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.schema.names == before.schema.names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(kept) > 60
        if name == "language":
            assert not kept & {9002, 9004} and {9001, 9003} <= kept
        if name == "line_dedup":
            assert 9001 not in kept
    assert 9003 not in kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in pieces.collect()} == kept


def test_line_stage_keeps_documents_with_words_left(spark):
    header = "one header of some more words"
    texts = [f"{header}\nfirst", f"{header}\nmilk\neggs", f"{header}\n你好世界", f"{header}\n \n", f"{header}\nfirst", "eggs\nkey: value", None, " \n"]
    docs = spark.createDataFrame([(n, text, 0) for n, text in enumerate(texts)], "doc_id long, text string, n_chars int")
    want = {0: texts[0], 1: "milk\neggs", 2: "你好世界", 5: "key: value", 6: None, 7: " \n"}
    found = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)


def test_no_language_goes_missing_beside_one_id_of_many_rows(spark):
    a, b, c = [n for n in range(30) if zlib.crc32(str(n).encode()) % 3 != 1][:3]
    one = [(a, f"the thing and the other number {n}", "en") for n in range(6500)]
    docs = spark.createDataFrame([*one, (b, "el uno y la otra cosa", "es"), (c, "le un et la chose", "fr")], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["en", "es", "fr"]


def test_a_rejecting_network_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.withColumn("my col", docs["n_chars"]), TABLES).select("doc_id").collect()}
    lettered = docs.filter("lang is not null and text rlike '[a-zA-Z]{3}'").toPandas()
    clean = set(lettered.doc_id)
    assert len(clean - kept) <= 0.002 * len(clean)
    random_ = np.random.default_rng(4)
    noise = "".join(random_.choice(list("abcdefghijklmnopqrstuvwxyz "), 400))
    odd = [
        (90001, "Это обычный русский текст, который не относится ни к одному из известных языков. " * 3),
        (90002, "这是一个普通的中文文本，不属于任何已知的语言。" * 6),
        (90003, noise),
        (90004, "これは普通の日本語の文章です。" * 6),
    ]
    more = docs.unionByName(spark.createDataFrame([(a, b, None, "s", 1) for a, b in odd], docs.schema))
    left = {r.doc_id for r in corpus_pipeline.language(spark, more, TABLES).select("doc_id").collect()}
    assert not left & {n for n, _ in odd}


def test_texts_under_one_id_are_judged_each(spark):
    a, b = ("one two three four five six seven eight nine ten %s " % w * 5 for w in ("alpha", "beta"))
    b = " ".join(f"word{n}" for n in range(60))
    docs = spark.createDataFrame([(1, a, 0), (2, b, 0), (2, a, 0), (2, b, 0)], "doc_id long, text string, k int")
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, a), (2, b)]


def test_toxicity_learns_from_one_text_of_an_id(spark):
    docs = [(3, f"clean words number {n}") for n in range(3000)] + [(n, "you awful fool " * 3 if n % 2 else "a kind word") for n in range(10, 400)]
    labels = [(3, 0)] + [(n, n % 2) for n in range(10, 400)]
    table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(table[0].filter("doc_id > 3"), toxicity.fit(*table, sample=500)).collect()}
    assert min(s for n, s in scores.items() if n % 2) > max(s for n, s in scores.items() if not n % 2)
