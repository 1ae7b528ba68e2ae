"""The pipeline's stages on null and repeated ids, ties, long texts, extra columns, unlabelled and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _kept string"


def through(spark, tmp_path, rows, items):
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(pipeline.COLUMNS) <= set(docs.columns) and "_kept" not in docs.columns
        kept[name] = docs.collect()
    return kept


@pytest.mark.parametrize("lang", ["en", None])
def test_awkward_documents(spark, tmp_path, lang):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cde fgh ijk lmn opq rst uvw xyz".split()) + str(rng.randrange(90))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    long = " ".join(word() for _ in range(60_000))
    item = " ".join(f"leak{i}" for i in range(20))
    rows = [(i, t, lang, None if i % 3 else "web", 0) for i, t in enumerate(texts)]
    rows += [(None, texts[0], lang, "web", 0), (None, "alone and short", lang, None, 0), (3, "another text under the id three", lang, "web", 0)]
    rows += [(20, None, lang, "web", 0), (21, "", lang, "web", 0), (22, " \t\n", lang, "web", 0), (23, "123 !!", lang, "web", 0)]
    rows += [(30, long, lang, "web", 0), (31, long + " end", lang, "web", 0), (40, f"{texts[1]} {item} {texts[2]}", lang, "web", 0), (50, "yes", lang, "web", 0)]
    kept = through(spark, tmp_path, rows, [(1, item), (2, "yes"), (None, None)])
    ids = {name: sorted(str(r["doc_id"]) for r in found) for name, found in kept.items()}
    clean = [str(r[0]) for r in rows if r[0] not in (20, 21, 22, 23)]
    assert ids["language"] == sorted(clean)
    assert {r["lang"] for r in kept["language"]} == {lang}
    clean.remove("0")  # its copy with the null id comes first
    clean.remove("31")
    assert ids["near_duplicates"] == sorted(clean)
    clean.remove("40")
    assert ids["leaks"] == sorted(clean)  # a one-word item is no sign of a leak
    assert set(ids["weights"]) <= set(clean) and ids["shards"] == ids["weights"]
    slots = {}
    for r in kept["shards"]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_unlabelled_documents_get_the_language_found(spark, tmp_path):
    rows = [(i, "der hund und die katze gehen in den wald", "de", "a", 0) for i in range(3)] + [(9, "die katze und der hund im wald", None, "a", 0)]
    rows += [(i, "the dog and the cat walk through these woods", "en", "a", 0) for i in range(3, 6)]
    spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = pipeline.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {0: "de", 1: "de", 2: "de", 3: "en", 4: "en", 5: "en", 9: "de"}


def test_empty_tables(spark, tmp_path):
    kept = through(spark, tmp_path, [], [])
    assert all(found == [] for found in kept.values())
    spark.createDataFrame([(1, "some words here", "en", "a", 0, "", "")], SCHEMA).withColumn("n_chars", F.lit(None).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() in (1, 2)


def test_texts_go_to_python_in_small_batches(spark):
    """Whatever the session starts with, a batch of texts stays small; a smaller bound of the session holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "ein Wort " * 2000, "de", "a", 9, None, None) for i in range(900)], SCHEMA).coalesce(1)
    try:
        for given, most in ((str(1 << 30), pipeline.BATCH), ("65536", 65536)):
            spark.conf.set(key, given)
            stage = pipeline.language(spark, docs, "")
            sizes = stage.select("text").mapInArrow(lambda it: (b.from_pydict({"n": [b.nbytes]}) for b in it), "n long")
            assert max(r["n"] for r in sizes.collect()) <= most + 200_000
    finally:
        spark.conf.unset(key)
