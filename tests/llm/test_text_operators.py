"""Decontamination, suffixes, lines and near-duplicates against brute force on small, awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from jumptrail.llm import suffixes
from jumptrail.llm.components import components
from jumptrail.llm.decontamination import benchmark_terms, build_index, contamination, near_matches, postings_of
from jumptrail.llm.lines import ENTRY, WIDE, apart, dealt, op7_line_dedup, repeated_lines, sketches, undealt, with_candidates, without_lines
from jumptrail.llm.near_duplicates import near_duplicates
from jumptrail.llm.suffixes import remove_repeats
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, k string, line int, kept int").repartition(3)


def prose(random_, words):
    return " ".join("".join(random_.choice("abcdefg") for _ in range(random_.randint(1, 6))) for _ in range(words))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, a repeated line, nulls, and one very long text."""
    random_ = random.Random(seed)
    texts = [prose(random_, random_.randint(20, 120)) for _ in range(60)]
    passage = prose(random_, 30)
    rows = [(n + 10, text) for n, text in enumerate(texts)]
    rows += [(100 + n, texts[3]) for n in range(20)]  # exact copies
    for n in range(40):  # near copies of one text
        words = texts[5].split()
        words[random_.randrange(len(words))] = f"new{n}"
        rows.append((200 + n, " ".join(words)))
    rows += [(300 + n, f"{prose(random_, 15)} {passage} {prose(random_, 9)}\nthe same line here\n\nÉa Éb {n}") for n in range(10)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "two words"), (6, "a" * 300), (7, "a" * 120), (8, "é" * 60)]
    rows += [(9, " ".join(texts)), (400, texts[7]), (400, texts[7]), (None, texts[8]), (401, "WORD")]
    return rows


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_contamination(spark):
    rows = corpus()
    items = [(1, " ".join(rows[2][1].split()[3:20])), (10, "TWO words"), (2, " ".join(rows[9][1].split()[:12]).upper()), (3, None), (3, "..."), (None, rows[4][1]), (2, rows[6][1])]
    benchmark = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, word int")
    got = Counter(
        (r.doc_id, r.n_words, r.n_hit, ",".join(r.items), r.contaminated) for r in contamination(documents(spark, rows), benchmark).collect()
    )
    want = Counter()
    for doc_id, text in rows:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            terms = words_of(item)
            n = min(10, len(terms))
            for start in range(len(terms) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == terms[start : start + n]:
                        hit.update(range(at, at + n))
                        found.update([str(item_id)] if item_id is not None else [])
        want[doc_id, len(words), len(hit), ",".join(sorted(found)), bool(hit)] += 1
    assert got == want
    assert contamination(documents(spark, rows).limit(0), benchmark).collect() == []
    assert {r.n_hit for r in contamination(documents(spark, rows), benchmark.limit(0)).collect()} == {0}


def test_near_matches_ignore_order(spark):
    docs = documents(spark, [(1, "x d c b a y"), (2, "a b c"), (3, "a " + "z " * 60 + "b c d")])
    terms = benchmark_terms(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    vocabulary = terms.select("word", F.col("place").cast("long").alias("term"))
    terms = terms.withColumn("term", F.col("place").cast("long"))
    found = near_matches(postings_of(build_index(docs, vocabulary)), terms, size=4, slack=10)
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"))
    assert [r.doc_id for r in found.join(keys, "k").collect()] == [1]


@pytest.mark.parametrize("crowd", [2, 2048])
def test_repeated_bytes(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows = corpus()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(documents(spark, rows)).collect())
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - 49) if doc_id is not None else ():
            first[data[at : at + 50]] = min(first.get(data[at : at + 50], doc_id), doc_id)
    want = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for at in range(len(data) - 49) if doc_id is not None else ():
            if first[data[at : at + 50]] < doc_id:
                mask[at : at + 50] = b"\1" * 50
        spans = sum(1 for at, m in enumerate(mask) if m and not (at and mask[at - 1]))
        want[doc_id, len(data), sum(mask), spans, bytes(b for b, m in zip(data, mask) if not m)] += 1
    assert got == want
    assert remove_repeats(documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [2, 2048])
def test_repeated_bytes_of_long_runs(spark, monkeypatch, crowd):
    """Fillers whose one gram stays the smallest: two runs differ only in the middle, or in a few places."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows = []
    for filler in " =<~!0a-":
        rows += [(len(rows), filler * 60 + "a" + filler * 60), (len(rows) + 1, filler * 60 + "c" + filler * 60)]
        rows += [(len(rows), filler * 400), (len(rows) + 1, f"{filler * 150}b{filler * 149}"), (len(rows) + 2, f"{filler * 149}b{filler * 150}")]
        rows += [(len(rows), f"{filler * 100}c{filler * 70}d{filler * 200}"), (len(rows) + 1, f"{filler * 100}d{filler * 70}c{filler * 200}")]
    first = {}
    for doc_id, text in rows:
        for at in range(len(text) - 49):
            first.setdefault(text[at : at + 50], doc_id)
    want = {}
    for doc_id, text in rows:
        mask = bytearray(len(text))
        for at in range(len(text) - 49):
            if first[text[at : at + 50]] < doc_id:
                mask[at : at + 50] = b"\1" * 50
        want[doc_id] = "".join(c for c, m in zip(text, mask) if not m).encode()
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(documents(spark, rows)).collect()} == want


def test_lines(spark):
    rows = [row for row in corpus() if row[0] is not None]
    rows += [(500, "a b c d e f g h i j\nx y\nx y\nA B C D E F G H I k"), (501, "the line of ten words is here now\na b c d e f g h i j")]
    variants = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine zehn"]
    rows += [(1000 - n, f"{variants[n % 3 == 0]}\n{n} alone here") for n in range(60)]  # copies in falling order of ids
    docs = documents(spark, rows)
    found = without_lines(docs, repeated_lines(docs))
    assert set(docs.columns) <= set(found.columns)
    lines = sorted(
        (doc_id, hashlib.md5((text or "").encode()).hexdigest(), number, frozenset(line.encode().lower().split()), text)
        for doc_id, text in dict.fromkeys(rows)
        for number, line in enumerate((text or "").split("\n"))
    )
    gone: dict[tuple, set[int]] = {}
    earlier: list[frozenset] = []
    for doc_id, _, number, words, text in lines:
        if len(words) >= 3:
            if any(100 * len(words & other) >= 80 * len(words | other) for other in earlier):
                gone.setdefault((doc_id, text), set()).add(number)
            earlier.append(words)
    want = Counter()
    for doc_id, text in rows:
        lost = gone.get((doc_id, text), set())
        kept = None if text is None else "\n".join(line for number, line in enumerate(text.split("\n")) if number not in lost)
        want[doc_id, kept, len(lost)] += 1
    assert Counter((r.doc_id, r._kept, r._removed) for r in found.collect()) == want
    assert repeated_lines(docs.limit(0)).collect() == []


def test_line_query_removes_short_copies(spark, tmp_path):
    texts = ["Read more\nalone\n你好世界你好世界\n\n---", "read  MORE\nx\n你好世界你好世界\n\nmore read", "a b c\nx\nd\n---\na b", "a b c d\na b"]
    documents(spark, list(enumerate(texts))).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [texts[0], "x\n", "a b c\nd\na b", "a b c d"]
    want = {(n, hashlib.sha256(text.encode()).hexdigest()) for n, text in enumerate(kept)}
    got = op7_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kept_sha256) for r in got} == want
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 3, 2: 2, 3: 1}


@pytest.mark.parametrize("percent, least_words", [(40, 1), (70, 2), (80, 1), (100, 1)])
def test_lines_of_few_words(spark, percent, least_words):
    random_ = random.Random(percent)
    rows = [(n, "\n".join(" ".join(random_.choices("abcdefgh", k=random_.randint(0, 6))) for _ in range(5))) for n in range(40)]
    want, earlier = set(), []
    for doc_id, text in rows:
        for number, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if len(words) >= least_words:
                if any(100 * len(words & other) >= percent * len(words | other) for other in earlier):
                    want.add((doc_id, number))
                earlier.append(words)
    docs = documents(spark, rows)
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"))
    found = repeated_lines(docs, percent, least_words).join(keys, "k").collect()
    assert {(r.doc_id, r.line) for r in found} == want


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rows = corpus(seed=4)
    got = near_duplicates(documents(spark, rows), words, percent).collect()
    sets = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        n = min(words, len(found))
        sets.append(frozenset(tuple(found[at : at + n]) for at in range(len(found) - n + 1)) if n else frozenset())
    parent = list(range(len(rows)))

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, one in enumerate(sets):
        for b in range(a):
            if one and sets[b] and 100 * len(one & sets[b]) >= percent * len(one | sets[b]):
                parent[root(a)] = root(b)
    groups: dict[int, list] = {}
    for number, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(number), []).append(doc_id)
    want = Counter()
    for number, (doc_id, _) in enumerate(rows):
        least = min((one for one in groups[root(number)] if one is not None), default=None)
        want[doc_id, len(sets[number]), least, doc_id == least] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert near_duplicates(documents(spark, rows).limit(0)).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(n, n + 1) for n in range(1, 60)] + [(100, n) for n in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, 61), 1) | dict.fromkeys(range(100, 160), 100) | {200: 200, 201: 200}
    assert got == want


def test_texts_under_one_id_whose_hashes_are_alike_in_part(spark):
    from jumptrail.llm.suffixes import remove_repeats

    short = F.pmod(F.xxhash64("text"), F.lit(1 << 16))
    a = "the first text, which a document with a smaller id has as well, word for word"
    same = spark.range(1).select(F.lit(a).alias("text")).select(short).first()[0]
    b = "another text of some length, of which nothing stands anywhere else; number "
    other = spark.range(400_000).select(F.concat(F.lit(b), F.col("id").cast("string"), F.lit(" " + b[::-1] * 8)).alias("text"))
    alike = other.filter(short == same).first()["text"]
    found = remove_repeats(spark.createDataFrame([(1, a), (5, a), (5, alike)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in found) == sorted([(1, len(a), 0), (5, len(a), len(a)), (5, len(alike), 0)])


def test_line_sketches_differ_by_no_more_than_the_sets(spark):
    random_ = np.random.default_rng(4)
    rows = [(0,) * 9]
    for size in (1, 10, 100, 1000) * 10:
        one, two = (np.unique(random_.integers(0, 1 << 40, size, dtype=np.uint64)) for _ in "ab")
        two = np.unique(np.concatenate((one[: random_.integers(0, one.size + 1)], two[: size // 3])))
        numbers = [sketches(words & np.uint64(63), np.array([words.size]), len(WIDE)) for words in (one, two)]
        rows.append((*[int(number[0]) for side in numbers for number in side], np.setxor1d(one, two).size))
    columns = ", ".join([f"{side}_{name} long" for side in "ab" for name in WIDE])
    found = spark.createDataFrame(rows, f"{columns}, differ long").select(apart(WIDE).alias("apart"), "differ").collect()
    assert all(0 <= r.apart <= r.differ for r in found)
    assert all(r.apart == 0 for r in found if r.differ == 0)
    assert any(r.apart > 200 for r in found)


def test_line_stage_keeps_columns_and_their_order(spark):
    rows = [("u", 1, "a b c\nx", 7, 1.5), ("v", 2, "a b c\ny", 7, 2.5), ("w", 3, "a b c", 5, None), ("z", None, None, 0, 3.5)]
    docs = spark.createDataFrame(rows, "`my.col` string, doc_id long, text string, n_chars int, _kept double")
    found = corpus_pipeline.line_dedup(spark, docs, "")
    assert found.columns == docs.columns
    assert set(map(tuple, found.collect())) == {rows[0], ("v", 2, "y", 1, 2.5), ("z", None, None, None, 3.5)}


def test_entries_of_suffixes_are_ranked_by_all_they_are_compared_by():
    random_ = np.random.default_rng(8)
    entries = np.zeros(5000, suffixes.ENTRY)
    for name, kinds in (("key", 900), ("print", 3), ("doc", 4)):
        entries[name] = random_.integers(0, kinds, entries.size)
    entries["key"][::7] |= np.uint64(1 << 63)  # above what a signed number holds
    want = sorted(entries[["key", "print", "doc"]].tolist())
    assert entries[suffixes.ranking(entries)][["key", "print", "doc"]].tolist() == want
    assert suffixes.ranking(entries[:0]).size == 0
    kept, covered = suffixes.settle(entries)
    least = {}
    for key, mark, doc in want:
        least.setdefault((key, mark), doc)
    assert kept[["key", "print", "doc"]].tolist() == [row for row in want if row[2] == least[row[:2]]]
    assert covered[["key", "print", "doc"]].tolist() == [row for row in want if row[2] > least[row[:2]]]


def test_lines_filed_are_those_with_a_candidate():
    random_ = np.random.default_rng(9)
    entries = np.zeros(400, ENTRY)
    entries["token"] = random_.integers(0, 6, entries.size)
    entries["set"] = random_.integers(0, 150, entries.size)
    entries["n"] = 5 + entries["set"] % 7  # of one set everywhere the same
    entries["pos"] = entries["set"] // 7 % 3
    entries["sketch"] = entries["set"] // 50 * 0x0303030303030303
    entries["doc_id"] = random_.integers(0, 90, entries.size)
    least: dict[tuple, int] = {}
    for row in entries:
        key = int(row["token"]), int(row["set"])
        least[key] = min(least.get(key, 99), int(row["doc_id"]))
    known = {int(row["set"]): (int(row["n"]), int(row["pos"]), int(row["set"]) // 50) for row in entries}
    want = set()
    for token, one in least:
        for other in (two for word, two in least if word == token and two != one):
            (n, pos, sketch), (m, at, wide) = known[one], known[other]
            overlap = -(-(n + m) * 80 // 180)
            if min(n, m) * 100 >= max(n, m) * 80 and min(n - pos, m - at) >= overlap and 48 * abs(sketch - wide) <= n + m - 2 * overlap:
                want.add((token, one, least[token, one]))
    parts = dealt(entries, 3)
    back = np.concatenate([undealt(blob.as_py()) for blob in parts.column("entries")])
    assert sorted(back.tolist()) == sorted(entries.tolist())
    assert {word for blob in parts.column("entries") for word in undealt(blob.as_py())["token"].tolist()} == set(range(6))
    found = with_candidates(back, 80)[["token", "set", "doc_id"]].tolist()
    assert len(found) == len(set(found)) and set(found) == want and 0 < len(want) < len(least)
    assert with_candidates(entries[:1], 80).size == 0
