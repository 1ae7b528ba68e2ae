"""A corpus pipeline: language, near-duplicates, benchmark leaks, source weights, shards.

Each stage reads what the one before it wrote.  Rows are told apart by a number that is
written with them, so repeated and null document ids do no harm, nor does a change of the
scan's splits while a stage runs.  Null ids count as smaller than others.  Null, blank and
letterless texts go in the first stage, so later ones need not expect any, but treat them as
texts without words.  Texts of any length are read whole.  Columns other than those of
``documents`` are left out.  Empty tables go through all stages.  The stages have Spark hand
texts to Python in batches of ``BATCH`` bytes, which stays set in the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, mixing, near_copies, sharding
from barloom.llm.common import read, settle, shared_folder, stored_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Row number in what the stages write for one another.
ROW = "_row"
SHARDS = 40
#: Bytes of an Arrow batch, about: 10,000 whole texts at once, in both directions, take too much of an executor's memory.
BATCH = 4 << 20


def _lean(spark: SparkSession) -> None:
    """Keep the batches that go to Python small; a stricter setting in plain bytes holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdecimal() or int(now) > BATCH:
        spark.conf.set(key, str(BATCH))


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with their stored row numbers; those of other tables are stored first."""
    if ROW in docs.columns:
        return docs.select(*COLUMNS, F.col(ROW).alias("row"))
    return stored_rows(docs.select(*COLUMNS), "row")


def _output(docs: DataFrame) -> DataFrame:
    """A stage's result, to be written once: the numbers are those of the written rows."""
    return docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label the documents with the language found in their text, and drop those that are in none.

    Those are documents without a text or without letters.  Where no document has a label to
    learn from, all that have letters stay, with their null labels.
    """
    _lean(spark)
    found = langid.language(docs, train=F.lit(True))
    named = docs.select(*COLUMNS, found.alias("found")).where("found.letters")
    return _output(named.withColumn("lang", F.when(F.col("found.lang") != langid.UNKNOWN, F.col("found.lang")).otherwise(F.col("lang"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates, of equal ids the first row.

    Near-duplicates share five-word shingles with a Jaccard similarity of at least 0.8.
    """
    _lean(spark)
    rows = _numbered(docs)
    gone = near_copies.near_copies(rows, "row").where("row != first").select("row")
    return _output(rows.join(gone, "row", "left_anti"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item of at least five words; shorter ones are no sign of a leak."""
    _lean(spark)
    rows = _numbered(docs)
    found = decontaminate.find_leaks(rows, read(spark, sf_dir, "benchmark"), id_col="row", least_words=5)
    gone = settle(found.select(F.col("id").alias("row")).distinct())
    return _output(rows.join(gone, "row", "left_anti"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop or repeat documents so that the sources reach their target words; null sources are one source."""
    _lean(spark)
    rows = _numbered(docs)
    mixed = mixing.mix(rows, keep=F.col("row")).where("copies > 0").select(F.col("kept").alias("row"), "copies")
    taken = rows.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return _output(taken)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's shard and its place in it; repeated rows get places of their own."""
    _lean(spark)
    rows = _numbered(docs)
    placed = sharding.shard(rows, SHARDS, id_col="row").select(F.col("id").alias("row"), "shard", "slot")
    return rows.join(placed, "row").select(*COLUMNS, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("weights", weights),
    ("shards", shards),
]
#: Shingles, walks and random rounding are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
