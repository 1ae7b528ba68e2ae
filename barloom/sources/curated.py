"""Readers of the curated Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas


def daily(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Daily bars; a start date prunes yearly folders and reaches the scan."""
    return _since(spark.read.schema(_with_year(schemas.DAILY)).parquet(root), since)


def index_daily(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    return _since(spark.read.schema(_with_year(schemas.INDEX_DAILY)).parquet(root), since)


def actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ACTIONS).parquet(path)


def constituents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONSTITUENTS).parquet(path)


def _with_year(schema: str) -> str:
    return f"{schema}, year int"


def _since(rows: DataFrame, since: str | None) -> DataFrame:
    if since is None:
        return rows
    rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
    return rows.where(F.col("year") >= int(since[:4])) if "year" in rows.columns else rows
