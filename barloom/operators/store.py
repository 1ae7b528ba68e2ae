"""Stored tables: yearly Parquet, replaced sessions, upserts, logs.

Plain Parquet has no merge, so the row changes are DataFrame operators on the old and the
new rows, and ``publish`` writes their result beside the table and swaps it in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def write_years(bars: DataFrame, root: str, key: str = "symbol", force: bool = True) -> None:
    """One directory a year, rows by (date, key), zstd; only the years of ``bars`` are replaced.

    A year may outgrow one task, so it is cut by range of date and key.  With ``force`` off,
    years that are already stored stay as they are, but for the last year of ``bars``, which
    is still growing.
    """
    rows = bars.withColumn("year", F.year("date"))
    if not force:
        try:
            held = bars.sparkSession.read.parquet(root).select("year").distinct()
            held = held.where(F.col("year") < rows.agg(F.max("year")).scalar())
            rows = rows.join(F.broadcast(held), "year", "left_anti")  # one row a year
        except AnalysisException:
            pass  # nothing is stored yet
    laid = rows.repartitionByRange("year", "date", key).sortWithinPartitions("year", "date", key)
    writer = laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("year").parquet(root)


def add_sessions(new: DataFrame, root: str, key: str = "symbol") -> None:
    """Put the sessions of ``new`` into the yearly table, each in place of what was stored of it.

    Only the years of ``new`` are read and written, so other sessions of a growing year stay,
    and doing it again changes nothing.  Lost executors do no harm, as rows are staged beside the
    table; a driver lost while Spark moves a staged year into place may leave that year empty,
    to be loaded again from the vendor's files.
    """
    spark = new.sparkSession
    try:
        held = spark.read.schema(StructType([*new.schema.fields, StructField("year", IntegerType())])).parquet(root)
    except AnalysisException:
        return write_years(new, root, key)  # nothing is stored yet
    years = [r["year"] for r in new.select(F.year("date").alias("year")).distinct().collect()]  # a row a year
    write_years(replace_session(held.where(F.col("year").isin(years)).drop("year"), new), root, key)


def read_years(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """The yearly table; a start date prunes years as well as rows."""
    rows = spark.read.parquet(root)
    if since:
        rows = rows.where((F.col("year") >= int(since[:4])) & (F.col("date") >= F.lit(since).cast("date")))
    return rows


def replace_session(old: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """All rows of the sessions in ``new`` are replaced, so dropped symbols do not linger."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; other old rows stay."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """As ``upsert``, but of rows that exist only the columns of ``update`` are replaced."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full_outer")

    def pick(c: str):
        if c in keys:
            return F.col(c)
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}")
        replace = F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in update))
        return F.when(replace, theirs).otherwise(mine).alias(c)

    return joined.select(*[pick(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti").select(*old.columns)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path, path of the rows that were replaced last)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".old"))
    return target.getFileSystem(conf), target, old


def recover(spark: SparkSession, path: str) -> None:
    """Put the old rows back where a publication was broken off between its two renames."""
    files, target, old = _files(spark, path)
    if files.exists(old):
        if files.exists(target):
            files.delete(old, True)
        else:
            files.rename(old, target)


def publish(rows: DataFrame, path: str) -> None:
    """Replace a table by rows that may be read from it: written beside it, then swapped in.

    A publication that was broken off before is made good first, so a table is never lost.
    """
    spark = rows.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    recover(spark, path)
    files, target, old = _files(spark, path)
    if files.exists(target):
        files.rename(target, old)
    files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target)
    files.delete(old, True)


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows of a key."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def with_payload(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and one JSON text of all other columns."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("data"))


def from_payload(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("_d", F.from_json("data", schema)).select(*[c for c in rows.columns if c != "data"], "_d.*")
