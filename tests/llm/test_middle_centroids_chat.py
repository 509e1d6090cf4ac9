"""Fill-in-the-middle, centroid clustering and chat formatting against plain Python, with odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

from jumptrail.llm import centroids, chat, middle

DOCS = "doc_id long, text string, lang string, n long, form string, `a b` string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_middle(doc_id: int | None, text: str | None, rate: int = 100, spm: int = 50) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


def odd_texts() -> list[str | None]:
    dice = random.Random(5)
    made = ["".join(dice.choice("ab<PSM>\n\né日𝄞 \r") for _ in range(dice.randrange(120))) for _ in range(150)]
    fixed = [None, "", "\n", "\n\n", "a", "a\nb", "a\nb\n", "x<P>y", "<", "<S", "é" * 40 + "\n日" * 30, "line\n" * 50, "a" * 300]
    return fixed + made + fixed


def same(rows, want) -> None:
    def key(row):
        return tuple((value is not None, value) for value in row)

    assert sorted((tuple(row) for row in rows), key=key) == sorted(want, key=key)


def test_middle_equals_plain_python_with_small_frames(spark):
    rows = [(i // 2 if i % 9 else None, text, "n", 1, "f", "z") for i, text in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = [plain_middle(row[0], row[1]) for row in rows]
    for frame in (1, 7, 64, middle.FRAME):
        same(middle.digests(middle.fill_in_middle(middle.store_frames(docs, frame))).collect(), want)
    assert {row[2] for row in want} == {"plain", "psm", "spm"}


def test_middle_rates_and_the_output_itself(spark):
    rows = [(i, f"one {i}\ntwo\nthree\nfour") for i in range(200)]
    stored = middle.store_frames(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    formed = middle.fill_in_middle(stored, rate=60, spm_rate=20)
    same(middle.digests(formed).collect(), [plain_middle(*row, 60, 20) for row in rows])
    for row in middle.output_texts(formed).collect():
        parts = re.fullmatch("<P>(.*)<S>(.*)<M>(.*)|<S>(.*)<P>(.*)<M>(.*)|(.*)", row["text"], re.DOTALL).groups()
        p = parts[:3] if row["form"] == "psm" else (parts[4], parts[3], parts[5])
        text = parts[6] if row["form"] == "plain" else p[0] + p[2] + p[1]
        assert text == dict(rows)[row["doc_id"]]


def test_middle_opens_only_the_frames_that_are_cut(spark):
    text = "".join(f"line {i}\n" for i in range(5000)).encode()
    row = middle.store_frames(spark.createDataFrame([(1, text.decode())], "doc_id long, text string"), 1000).first().asDict()
    opened = []

    class Counted:
        def decompress(self, data):
            opened.append(len(data))
            return middle.zstandard.ZstdDecompressor().decompress(data)

    for line in (0, 1, 2500, 4999, 5000):
        cut = middle.Cut(row, line, Counted())
        assert cut.chars == len(b"".join(text.splitlines(True)[:line]))
    assert len(opened) == 3 and len(row["at"]) > 40


def test_middle_long_text_and_empty_table(spark):
    long = "".join(f"row {i} of a long text\n" for i in range(200_000)) + "x" * 300_000
    docs = spark.createDataFrame([(4, long)], "doc_id long, text string")
    same(middle.digests(middle.fill_in_middle(middle.store_frames(docs))).collect(), [plain_middle(4, long)])
    empty = spark.createDataFrame([], DOCS)
    found = middle.digests(middle.fill_in_middle(middle.store_frames(empty)))
    assert found.count() == 0 and found.columns[0] == "doc_id"


# --- centroids ---

VECTORS = "vec_id long, embedding array<float>, x string, cluster int, `a b` string"


def plain_clusters(rows, k, rounds, dimensions):
    import math

    kept = [
        (i, [math.floor(256 * v) for v in e])
        for i, e in rows
        if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)
    ]
    order = sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))
    cents = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for c in range(len(cents)):
            mine = [x for (_, x), at in zip(kept, of) if at == c]
            if mine:
                cents[c] = [sum(column) // len(mine) for column in zip(*mine)]
    last = [(i, *near(x)) for i, x in kept]
    inertia = {c: sum(d for _, d, at in last if at == c) for c in range(len(cents))}
    return [(i, at, d, inertia[at], sum(inertia.values()), sha(",".join(map(str, cents[at])))) for i, d, at in last]


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "x", 7, "z") for i, e in rows], VECTORS)


def test_clusters_equal_plain_python(spark):
    dice = random.Random(3)
    rows = [(i % 150, [dice.choice((-1.5, -0.25, 0.125, 0.0, dice.uniform(-2, 2))) for _ in range(4)]) for i in range(200)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 1.0, 1.0]), (1004, [float("nan")] * 4)]
    rows += [(1005, [float("inf")] * 4), (1006, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [(2000 + i, [0.75] * 4) for i in range(100)]  # a third of all rows are one vector
    for k, rounds in ((6, 5), (1, 2), (3, 0)):
        found = centroids.cluster(vectors(spark, rows), k, rounds, 4)
        same(found.collect(), plain_clusters([(i, [v if v is None else float(v) for v in e] if e is not None else None) for i, e in rows], k, rounds, 4))


def test_clusters_of_fewer_vectors_than_centroids_and_of_none(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-0.001, 0.0])]
    same(centroids.cluster(vectors(spark, rows), 40, 5, 2).collect(), plain_clusters(rows, 40, 5, 2))
    none = centroids.cluster(vectors(spark, [(1, None), (2, [1.0])]), 40, 5, 2)
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_clusters_leave_out_vectors_whose_distances_fit_no_long(spark):
    rows = [(1, [1.0, 1.0]), (2, [3e38, 0.0]), (3, [centroids.LARGEST, -centroids.LARGEST])]
    assert {row["vec_id"] for row in centroids.cluster(vectors(spark, rows), 2, 3, 2).collect()} == {1, 3}


def test_distances_run_in_the_jvm(spark):
    stored = centroids.integer_vectors(vectors(spark, [(1, [0.5, 0.5])]), 2)
    plan = stored.select(centroids.nearest(stored["x"], [[1, 2], [3, 4]]))._jdf.queryExecution().toString()
    assert "zip_with" in plan and "aggregate" in plan and "array_min" in plan and "Python" not in plan


# --- chat ---

TURNS = "conv_id long, turn long, role string, text string, formatted string, loss string"


def chat_rows(spark, rows):
    turns = spark.createDataFrame([(*row, "f", "l") for row in rows], TURNS)
    made = chat.conversations(turns.withColumn("parts", chat.text_parts(turns["text"])))
    return made, {row["conv_id"]: row for row in chat.read_back(made).collect()}


def test_every_text_comes_back(spark):
    dice = random.Random(8)
    marks = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|part|>", "<|image|>", "<", "|", "\\", ">", "\n", "a", "é", "𝄞", "", "<\\|", "user"]
    texts = ["".join(dice.choices(marks, k=dice.randrange(9))) for _ in range(300)]
    rows = [(i % 40, i // 40, dice.choice(["user", "assistant", "system", marks[i % 16]]), text) for i, text in enumerate(texts)]
    _, back = chat_rows(spark, rows)
    for conv in range(40):
        mine = sorted((row for row in rows if row[0] == conv), key=lambda row: row[1])
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [row[2:] for row in mine]
        assert "".join(back[conv]["learned"]) == "".join(row[3] for row in mine if row[2] == "assistant")


def test_nulls_ties_and_repeated_turns(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, "assistant", None), (1, 2, "user", "a"), (None, 0, None, "x"), (2, 1, "assistant", "")]
    _, back = chat_rows(spark, rows)
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("", "x")]
    assert back[2]["learned"] == [""]
    _, none = chat_rows(spark, [])
    assert none == {}


def test_typed_parts_become_placeholders_in_order(spark):
    parts = [
        ("text", "look <|image|> ", None, None, None, None, None),
        ("image", None, "a.png", 57, 28, None, None),
        ("text", "one", None, None, None, None, None),
        ("text", "two", None, None, None, None, None),
        ("audio", "ignored", "b.wav", None, None, 1.5, None),
        ("document", None, "c.pdf", None, None, None, 3),
        ("sticker", "?", "d.webp", None, None, None, None),
        (None, "plain", None, None, None, None, None),
        None,
        ("image", None, None, None, -5, None, None),
    ]
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", parts[1:2]), (1, 2, "user", None), (1, 3, "assistant", [])], schema)
    made = chat.conversations(turns)
    row = made.first()
    assert row["formatted"] == (
        "<|im_start|>assistant<|im_sep|>look <\\|image|> <|image|>one<|part|>two<|audio|><|document|><|document|>plain<|part|>"
        "<|image|><|im_end|><|im_start|>user<|im_sep|><|image|><|im_end|><|im_start|>user<|im_sep|><|im_end|>"
        "<|im_start|>assistant<|im_sep|><|im_end|>"
    )
    assert [tuple(a) for a in row["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 3072), ("document", "d.webp", 0), ("image", None, 0),
        ("image", "a.png", 3),
    ]
    assert row["expanded_tokens"] == 3 + 38 + 3072 + 3
    back = chat.read_back(made).first()
    assert back["learned"] == ["look <|image|> ", "one", "two", "plain", ""]
    assert back["turns"][0]["placeholders"] == ["image", "audio", "document", "document", "image"]
    assert back["turns"][0]["text"] == "look <|image|> onetwoplain" and back["turns"][2]["text"] == ""


def test_a_long_conversation_is_combined_before_it_moves(spark):
    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é', id) AS text")
    made = chat.conversations(turns.repartition(8).withColumn("parts", chat.text_parts(turns["text"])))
    back = chat.read_back(made).first()
    assert len(back["turns"]) == 20_000 and "".join(back["learned"]) == "".join(f"é{i}" for i in range(1, 20_000, 2))
    plan = made._jdf.queryExecution().toString()
    assert "partial_collect_list" in plan and "Python" not in plan
