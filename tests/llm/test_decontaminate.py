"""Recall of benchmark decontamination by item length, its words, slices of long texts, awkward ids."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate


def edited(rng, words, edits):
    """The words with that many of them replaced, doubled by another or removed."""
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 1)] = [f"new{rng.randrange(10**6)}"] * (kind != 2)
    return words


def distance(item, text):
    """Word edits between the item and the best run of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


@pytest.mark.parametrize("length", [1, 5, 30, 200])
def test_recall_by_length(spark, length):
    rng = random.Random(length)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, [f"i{k}x{j}" if length == 1 else word() for j in range(length)]) for k in range(20)]
    most, rows, want = length // 5, [], set()
    for i in range(240):
        k, item = items[i % 20]
        text = [word() for _ in range(40)] + edited(rng, item, most) + [word() for _ in range(40)]
        rows.append((i, " ".join(text)))
        if distance(item, text) <= most:
            want.add((i, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    sure = {(i, k) for i, k in got - want if distance(items[k][1], rows[i][1].split()) <= most}
    assert got - want == sure and len(want) >= 200
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("similarity", [0.4, 0.6, 1.0])
def test_lower_similarity_loses_nothing_to_the_sieve(spark, similarity):
    rng = random.Random(5)
    item = [f"a{i}" for i in range(12)]
    most = int((1 - similarity) * 12 + 1e-9)
    rows = [(i, " ".join(["x", "y", *edited(rng, item, most), "z"])) for i in range(60)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("q", " ".join(item))], "item_id string, text string")
    found = decontaminate.find_leaks(docs, benchmark, similarity=similarity).collect()
    assert len(found) >= 57 and {r["item_id"] for r in found} == {"q"} and max(r["edits"] for r in found) <= most


def test_words_of_scripts():
    lexer = decontaminate.Lexer()
    cut = lambda text: [text.encode()[a:b].decode() for a, b in zip(*lexer(text.encode())[:2], strict=True)]
    assert cut("don't “quote” élan — a1") == ["don", "t", "quote", "élan", "a1"]
    assert cut("今天, ok。天か") == ["今", "天", "ok", "天", "か"]
    assert cut("") == [] and cut("...") == [] and cut("…") == []
    one, two = lexer("x 今天".encode())[2], lexer("今天".encode())[2]
    assert one[1:].tolist() == two.tolist()


def test_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 4000)
    rng = random.Random(6)
    item = [f"q{i}" for i in range(30)]
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(500)}" for _ in range(3000)]
        at = rng.randrange(3000)
        rows.append((i, at, " ".join(words[:at] + item + words[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, at long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item))], "item_id long, text string")
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted((r["id"], r["first_word"], r["edits"]) for r in found) == sorted((i, at, 0) for i, at, _ in rows for _ in range(2))


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("id", "row", "words", "item", "key", "run")})
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(9, "A B c d e F!")], "item_id int, text string"))
    assert sorted((str(r["id"]), r["edits"], r["words"]) for r in found.collect()) == [("1", 0, 6), ("1", 0, 6), ("None", 0, 6)]
    short = decontaminate.find_leaks(docs, spark.createDataFrame([(9, "a b")], "item_id int, text string"), least_words=5)
    assert short.count() == 0
