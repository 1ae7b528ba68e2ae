"""Near copies of documents against brute force, alone and in the pipeline's stage."""

import itertools
import random

from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline as pipeline
from barloom.llm import near_copies, verify


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_first(rows):
    """The first id of every id's group, from all pairs."""
    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def planted(rng):
    """Texts with copies that differ in up to 4 of 150 words, a crowd around one of them, and short ones."""
    pool = [f"w{i}" for i in range(500)]
    base = [[rng.choice(pool) for _ in range(150)] for _ in range(30)]
    texts = [" ".join(x) for x in base]
    for n in [i for i in range(1, 30) for _ in range(2)] + [0] * 200:
        words = list(base[n])
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = rng.choice(pool)
        texts.append(" ".join(words))
    return texts + ["one two", "One  two", "one", "", None, "a b c d e", "a b c d f"]


def test_near_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = list(enumerate(planted(random.Random(41))))
    expected = brute_first(rows)
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, doc_id long, text string").coalesce(1)
    found = {r["row"]: r["first"] for r in near_copies.near_copies(docs, "row").collect()}
    assert found == expected
    assert near_copies.near_copies(docs.limit(0), "row").count() == 0


def test_stage_drops_near_copies(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(planted(random.Random(42))) if t]
    table = [(i, t, "en", "a", len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted(r[0] for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert kept == sorted(set(brute_first(rows).values()))


def crowd(rng):
    """Copies of one text of which two have a similarity of about 0.6, so that keys are shared and hardly any are linked."""
    pool = [f"w{i}" for i in range(500)]
    base = [rng.choice(pool) for _ in range(150)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), 5):
            words[at] = rng.choice(pool)
        texts.append(" ".join(words))
    return texts


def test_joins_of_a_crowd_grow_with_its_texts(spark, monkeypatch):
    """Ids are joined, not the places where they meet others."""
    rows, made, plain = list(enumerate(crowd(random.Random(43)))), [], DataFrame.join

    def join(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", join)
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, doc_id long, text string").coalesce(1)
    found = {r["row"]: r["first"] for r in near_copies.near_copies(docs, "row").collect()}
    assert found == brute_first(rows)
    assert max(made) <= 2 * len(rows)


def test_crowded_centres_and_blocks_match_brute_force(spark, monkeypatch):
    for name, size in (("CROWDED", 8), ("SPAN", 64), ("TEXTS", 8)):
        monkeypatch.setattr(verify, name, size)
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = list(enumerate(planted(random.Random(44)) + crowd(random.Random(45))[:120]))
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, doc_id long, text string").coalesce(1)
    assert {r["row"]: r["first"] for r in near_copies.near_copies(docs, "row").collect()} == brute_first(rows)
