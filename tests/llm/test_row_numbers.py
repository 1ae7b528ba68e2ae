"""Row numbers that stay the same when the splits of a scan change between two reads."""

import pytest

import corpus_pipeline as pipeline
from barloom.llm import lines, mixing, near_copies, sharding

TEXTS = [f"a w{i} x{i} y{i} z{i} end" for i in range(60) for _ in range(2)]


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    yield spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def splits_change_after(monkeypatch, spark, module, name):
    before = getattr(module, name)

    def changed(*args, **kwargs):
        found = before(*args, **kwargs)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    monkeypatch.setattr(module, name, changed)


def test_near_duplicates_after_a_change_of_splits(spark, docs, monkeypatch):
    splits_change_after(monkeypatch, spark, near_copies, "near_copies")
    kept = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 120, 2))
    assert len({r[pipeline.ROW] for r in kept}) == 60


def test_shards_after_a_change_of_splits(spark, docs, monkeypatch):
    splits_change_after(monkeypatch, spark, sharding, "shard")
    assert sorted(r["doc_id"] for r in pipeline.shards(spark, docs, "").collect()) == list(range(120))


def test_weights_after_a_change_of_splits(spark, docs, monkeypatch):
    splits_change_after(monkeypatch, spark, mixing, "mix")
    assert {r["doc_id"] for r in pipeline.weights(spark, docs, "").collect()} == set(range(120))


def test_kept_lines_after_a_change_of_splits(spark, docs, monkeypatch):
    splits_change_after(monkeypatch, spark, lines, "components")
    kept = {r["id"]: r["kept"] for r in lines.kept_lines(docs).collect()}
    assert kept == {i: [0] if i % 2 == 0 else [] for i in range(120)}


def test_later_stages_read_the_written_numbers(spark, docs, tmp_path, monkeypatch):
    pipeline.near_duplicates(spark, docs, "").write.parquet(f"{tmp_path}/stage")
    stage = spark.read.parquet(f"{tmp_path}/stage")
    written = {r["doc_id"]: r[pipeline.ROW] for r in stage.collect()}
    monkeypatch.setattr(pipeline, "stored_rows", None)
    assert {r["doc_id"]: r["row"] for r in pipeline._numbered(stage).collect()} == written
