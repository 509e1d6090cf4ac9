"""URL rules, packing, training order and nearest neighbours against plain Python on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from jumptrail.llm import nearest, training_order
from jumptrail.llm.nearest import neighbours
from jumptrail.llm.packing import LENGTH, pack_documents, plan
from jumptrail.llm.tokens import Encoder
from jumptrail.llm.training_order import materialise, permute, read_from, read_index
from jumptrail.llm.url_rules import CONTRACT, RULES, Rule, file_rules, judge_urls
from jumptrail.shared import fresh_path

DOCS = "doc_id long, text string, sequence_id string, k string"


def documents(spark, rows):
    """Rows of doc_id and text with other columns whose names clash with those of results."""
    return spark.createDataFrame([(one, text, "x", "y") for one, text in rows], DOCS)


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.ORG/en/1x?q=/cart/"),
        (1, "https://WWW.Example.ORG/en/1x?q=/cart/"),
        (2, "http://example.org/es/9"),
        (3, "http://notexample.org"),
        (4, "http://a.com/de/1"),
        (5, "http://a.com/fr/1?sessionid=2"),
        (6, None),
        (7, "mailto:x@y.org/"),
        (8, "x://adult-z.net/en"),
        (9, "x://net/cart/"),
        (None, ""),
        (11, "x://org/en/1"),
    ]
    pages = spark.createDataFrame([(a, b, "h", 1) for a, b in rows], "page_id long, url string, host string, verdict int")
    got = sorted(map(tuple, judge_urls(pages).collect()), key=str)
    want = [
        (1, "www.example.org", "/en/1x", "example.org/en/1", "block"),
        (1, "www.example.org", "/en/1x", "example.org/en/1", "block"),
        (2, "example.org", "/es/9", "example.org/es/", "block"),
        (3, "notexample.org", "", None, "allow"),
        (4, "a.com", "/de/1", "com/de/", "block"),
        (5, "a.com", "/fr/1", "com/fr/", "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "adult-z.net", "/en", None, "block"),
        (9, "net", "/cart/", None, "block"),
        (None, "", "", None, "allow"),
        (11, "org", "/en/1", "org/", "allow"),
    ]
    assert got == sorted(want, key=str)
    assert judge_urls(pages.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token():
    counts = {"example": 5, "org": 9, "en": 2}
    assert file_rules([CONTRACT[2], Rule("*x*")], counts) == {"en": [0], "": [1]}
    assert [rule.tokens for rule in RULES[:2]] == [["org"], ["example", "org", "es"]]


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_and_few_sequences(seed):
    random.seed(seed)
    pieces = Counter(random.choice([1, 2, 3, 500, 512, 700, random.randint(1, 1024), 1024]) for _ in range(400))
    patterns = plan(pieces)
    used = Counter()
    for pattern, number in patterns:
        assert sum(pattern) <= LENGTH and number > 0
        for n in pattern:
            used[n] += number
    assert used == pieces
    least = -(-sum(n * count for n, count in pieces.items()) // LENGTH)
    assert sum(number for _, number in patterns) <= 1.25 * least + 1
    assert plan({}) == []


def test_plan_is_made_of_exact_complements():
    random_ = np.random.default_rng(7)
    pieces = Counter(np.minimum(random_.lognormal(6, 0.9, 50_000).astype(int) + 1, LENGTH).tolist())
    patterns = plan(pieces)
    exact = Counter()
    for pattern, number in patterns:
        exact[len(pattern)] += number * (sum(pattern) == LENGTH)
    assert min(exact[2], exact[3], exact[4]) > 0
    least = -(-sum(n * count for n, count in pieces.items()) // LENGTH)
    assert sum(number for _, number in patterns) <= 1.005 * least
    assert plan({600: 4, 224: 8, 200: 4, 1024: 3}) == [((1024,), 3), ((600, 224, 200), 4), ((224, 224, 224, 224), 1)]


def test_packing_places_every_piece_gapless(spark):
    words = "one two three four five six " * 600
    rows = [(1, words), (2, ""), (3, None), (4, "short text"), (4, "short text"), (None, "<|endoftext|> é\x1c 日本"), (6, "a b")]
    got = pack_documents(documents(spark, rows)).collect()
    encoder = Encoder()
    want = Counter()
    for doc_id, text in rows:
        ids = encoder.whole(text or "") + [2]
        start = 0
        for piece, n in enumerate(([len(ids) % LENGTH] if len(ids) % LENGTH else []) + [LENGTH] * (len(ids) // LENGTH)):
            want[doc_id, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for row in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == ends[row.sequence_id]
        ends[row.sequence_id] += row.length
    assert max(ends.values()) <= LENGTH
    assert pack_documents(documents(spark, [])).collect() == []


def test_encoder_agrees_with_the_tokenizer():
    encoder = Encoder()
    for text in ["", " a  b\n\n c\t\td ", "don't  ", "x² ½ “q” — …", "<|endoftext|>", "日本\u3000語", "a\x1cb\x85c", "é" * 300, "1 23  4"]:
        assert encoder(text) == encoder.whole(text)


def test_permutation_is_one_to_one():
    for size in (1, 2, 5, 1000, 4096, 5001):
        assert sorted(permute(np.arange(size), size, 9).tolist()) == list(range(size))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()


def test_training_order_round_trip(spark):
    rows = [(n, f"text number {n} " * (n % 40)) for n in range(200)] + [(None, None), (7, "again"), (7, "again")]
    path = fresh_path(spark, "order")
    materialise(documents(spark, rows).repartition(3), path, shards=4, length=64)
    index = read_index(spark, path, shards=4, length=64).orderBy("slot").collect()
    assert [row.slot for row in index] == list(range(len(index)))
    encoder = Encoder()
    assert sum(row.n_tokens for row in index) == sum(len(encoder(text or "")) + 1 for _, text in rows)
    of_shard = [row for row in index if row.shard == 2]
    read = list(read_from(spark, path, 2, 1, 64))
    assert [zlib.crc32(np.array(ids, "<u2").tobytes()) for ids in read] == [row.ids_crc32 for row in of_shard[1:]]


def test_training_order_holds_every_sequence_where_the_permutation_puts_it(spark):
    rows = [(n, f"text {n} " * (n % 30)) for n in range(150)] + [(None, None), (7, "again"), (7, "a long one " * 3000)]
    path = fresh_path(spark, "order")
    materialise(documents(spark, rows).coalesce(1), path, shards=3, length=64)
    encoder = Encoder()
    ids = [one for _, text in rows for one in [*encoder.whole(text or ""), 2]]
    cut = [ids[at : at + 64] for at in range(0, len(ids), 64)]
    want = [cut[number] for number in np.argsort(permute(np.arange(len(cut)), training_order.ORDINALS))]
    assert [one for shard in range(3) for one in read_from(spark, path, shard, 0, 64)] == want
    first = list(read_from(spark, path, 0, 0, 64))
    assert list(read_from(spark, path, 0, len(first) - 1, 64)) == first[-1:]
    assert list(read_from(spark, path, 0, len(first), 64)) == []


def test_training_order_of_an_empty_table(spark):
    path = fresh_path(spark, "order")
    materialise(documents(spark, []), path, shards=3, length=64)
    assert read_index(spark, path, 3, 64).collect() == []
    assert list(read_from(spark, path, 0, 0, 64)) == []


def test_neighbours_find_the_true_ones(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTOR_BLOCK", 40)
    random_ = np.random.default_rng(3)
    vectors = [random_.standard_normal(8).tolist() for _ in range(600)]
    rows = [(n, vector) for n, vector in enumerate(vectors)]
    rows += [(n, vectors[0]) for n in range(600, 900)]  # one vector holds a third of all rows
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, [1.0]), (None, [1.0] * 8), (5, vectors[5])]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = neighbours(table, "vec_id", "embedding", "id % 20 = 0").collect()
    matrix, found, total = np.array([vector for _, vector in rows[:900]]), 0, 0
    by_query: dict[int, list] = {}
    for row in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(row.query_id, []).append(row)
    assert sorted(by_query) == list(range(0, 900, 20))
    for query, answer in by_query.items():
        scores = (matrix * matrix[query]).sum(axis=1)
        scores[query] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:20].tolist()
        assert [row.rank for row in answer] == list(range(1, 21))
        assert all(row.score == scores[row.vec_id] for row in answer)
        found, total = found + len(set(best) & {row.vec_id for row in answer}), total + 20
    assert found / total >= 0.9
    assert by_query[600][0].vec_id == 0  # ties go to the smaller id
    assert neighbours(table.limit(0), "vec_id", "embedding", "id % 20 = 0").collect() == []
