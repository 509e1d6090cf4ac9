"""Benchmark decontamination through a distributed positional inverted index, in DataFrame operations only.

`build_index` stores a posting (document key, position, term) for every training word that some benchmark item has.
A window is `size` consecutive words of an item (a shorter item is one window). `phrase_matches` counts postings by
term, takes the two rarest terms of every window, shifts their postings by the term's place in the item and keeps
the alignments (document, item, shift) where both lists meet. Only those alignments are laid over the remaining
postings, and runs of agreeing positions at least a window long are matches. `near_matches` finds windows all of
whose terms occur, in any order, within some words of the rarest one.

A document is known by a key, the hash of its id and text, so the same row read again is the same document. Word
lists are never collected; a hot document or term is only many rows. Spark broadcasts vocabulary, anchors and
candidate documents while they are below its threshold and shuffles them beyond.

Defined results: a null text has no words; rows that repeat an id and a text give the same answer each; rows that
share an id with other texts are judged each; items without words match nothing; items that share an id count once;
an item without an id counts in n_hit but not in the list of items; an empty table gives an empty table, and no
benchmark gives no hits. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jumptrail.shared import written

SIZE = 10

# What parts words; A-Z are read as a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words as they are written; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded(word: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """item (a number for each row with words), item_id, n words, place, word."""
    items = benchmark.select("item_id", F.transform(words_of(F.col("text")), folded).alias("words"))
    items = written(items.filter(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    return items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows k, doc_id, n_words, pos, term, stored; no shuffle, and texts are read this one time.

    A posting for every word in the vocabulary (word, term). The first word of a document has a row whatever it is, and
    a document without words one without position, so every row of the table has one that carries its number of words."""
    words = docs.select("doc_id", document_key().alias("k"), words_of(F.col("text")).alias("words"))
    words = words.select("doc_id", "k", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "raw"))
    found = words.withColumn("word", folded(F.col("raw"))).join(vocabulary, "word", "left")
    found = found.filter(F.col("term").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    return written(found.select("k", "doc_id", "n_words", "pos", "term"), "postings")


def postings_of(index: DataFrame) -> DataFrame:
    """k, pos, term of the words that the benchmark has."""
    return index.filter(F.col("term").isNotNull()).select("k", "pos", "term")


def documents_of(index: DataFrame) -> DataFrame:
    """doc_id, k, n_words of every row of the documents."""
    return index.filter(F.col("pos").isNull() | (F.col("pos") == 0)).select("doc_id", "k", F.col("n_words").cast("long").alias("n_words"))


def rarest(terms: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Of every window of every item the places and terms of the two rarest: item, j1, t1, j2, t2."""
    by_item = (
        terms.join(counts, "term", "left")
        .groupBy("item", "n")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("all"))
    )
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - size + 1, F.lit(1))))
    window = F.slice(F.col("all"), F.col("start"), F.lit(size))
    ranked = F.array_sort(F.transform(window, lambda t: F.struct(t["count"], t["place"], t["term"])))
    return (
        by_item.withColumn("start", starts)
        .withColumn("ranked", ranked)
        .select("item", F.col("ranked")[0].alias("a"), F.col("ranked")[F.when(F.size("ranked") > 1, 1).otherwise(0)].alias("b"))
        .select(
            "item", F.col("a.place").alias("j1"), F.col("a.term").alias("t1"),
            F.col("b.place").alias("j2"), F.col("b.term").alias("t2"),
        )
        .distinct()
    )


def phrase_matches(postings: DataFrame, terms: DataFrame, size: int = SIZE) -> DataFrame:
    """Every maximal run of words, a window long at least, that a document shares with an item: k, item, item_id,
    first and last position in the document."""
    counts = postings.groupBy("term").count()
    anchors = written(rarest(terms, counts, size), "anchors")
    first = anchors.select(
        F.col("t1").alias("term"), "item", "j1", "j2", F.col("j1").alias("j"),
        F.when(F.col("j1") == F.col("j2"), 3).otherwise(1).alias("role"),
    )
    second = anchors.filter("j1 <> j2").select(
        F.col("t2").alias("term"), "item", "j1", "j2", F.col("j2").alias("j"), F.lit(2).alias("role")
    )
    roles = written(first.unionByName(second), "roles")
    met = (
        postings.join(roles, "term")
        .groupBy("k", "item", "j1", "j2", (F.col("pos") - F.col("j")).alias("shift"))
        .agg(F.bit_or("role").alias("roles"))
        .filter("roles = 3")
    )
    alignments = written(met.select("k", "item", "shift").distinct(), "alignments")
    held = postings.join(alignments.select("k").distinct(), "k", "left_semi")
    expected = alignments.join(terms.select("item", "item_id", "n", "place", "term"), "item").withColumn(
        "pos", F.col("shift") + F.col("place")
    )
    agreeing = expected.join(held, ["k", "pos", "term"]).select("k", "item", "item_id", "n", "shift", "place").distinct()
    in_order = Window.partitionBy("k", "item", "shift").orderBy("place")
    runs = agreeing.withColumn("run", F.col("place") - F.row_number().over(in_order))
    return (
        runs.groupBy("k", "item", "item_id", "n", "shift", "run")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .filter(F.col("high") - F.col("low") + 1 >= F.least(F.lit(size), F.col("n")))
        .select("k", "item", "item_id", (F.col("shift") + F.col("low")).alias("first"), (F.col("shift") + F.col("high")).alias("last"))
    )


def near_matches(postings: DataFrame, terms: DataFrame, size: int = SIZE, slack: int = 20) -> DataFrame:
    """Windows all of whose terms a document has within `slack` words of the window's rarest: k, item, start."""
    counts = postings.groupBy("term").count()
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0))))
    items = terms.select("item", "n").distinct().withColumn("start", starts)
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + size)
    windows = items.join(terms.select("item", "place", "term"), "item").filter(inside).select("item", "start", "term").distinct()
    windows = written(windows.join(counts, "term", "left").fillna(0, ["count"]), "windows")
    rare = windows.groupBy("item", "start").agg(F.min_by("term", F.struct("count", "term")).alias("term"), F.count("*").alias("wanted"))
    at = written(postings.join(rare, "term").select("k", "item", "start", "wanted", F.col("pos").alias("centre")), "centres")
    others = at.join(windows.select("item", "start", "term"), ["item", "start"])
    near = others.join(postings, ["k", "term"]).filter(F.abs(F.col("pos") - F.col("centre")) <= slack)
    return (
        near.select("k", "item", "start", "wanted", "centre", "term").distinct()
        .groupBy("k", "item", "start", "wanted", "centre").count()
        .filter("count = wanted").select("k", "item", "start").distinct()
    )


def indexed(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of documents with doc_id and text, and the terms of a benchmark with item_id and text."""
    terms = benchmark_terms(benchmark)
    vocabulary = written(terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    terms = written(terms.join(vocabulary, "word"), "terms")
    return build_index(docs, vocabulary), terms


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, k, n_words, n_hit, n_items, items (sorted ids as text), contaminated."""
    index, terms = indexed(docs, benchmark)
    found = written(phrase_matches(postings_of(index), terms, size), "matches")
    hit = (
        found.select("k", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
        .groupBy("k").agg(F.count("*").alias("n_hit"))
    )
    items = (
        found.select("k", F.col("item_id").cast("string").alias("item_id")).distinct()
        .groupBy("k").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    marked = written(hit.join(items, "k", "left"), "contaminated")
    return (
        documents_of(index)
        .join(marked, "k", "left")
        .select(
            "doc_id",
            "k",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), spans AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM spans
), grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
), found AS (SELECT r, n, i, item_id FROM grams JOIN spans USING (n, gram)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
