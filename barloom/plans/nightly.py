"""The nightly run over a folder of curated tables: lists, sessions, actions, served tables, in this order.

ROOT holds ``daily`` and ``index_daily`` by year, ``constituents``, ``filings`` and
``corporate_actions``; ``ROOT/published`` is what readers see.  Every step may be repeated: a
session, a list, a filing and a published row replace their like.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barloom import schemas
from barloom.operators import serving, store
from barloom.plans.snapshot import Snapshot, corporate_actions, snapshot
from barloom.sources import curated, raw

MARKET = ("NIFTY 500", "NIFTY 50")
LOG = "ts timestamp, job string, date date, status string, detail string"


@dataclass
class Files:
    """The vendor's files of one session; what is not given stays as it is stored."""

    daily: str
    indices: str | None = None
    #: Index name: file of its members.
    lists: dict[str, str] = field(default_factory=dict)
    filings: str | None = None
    delivery: str | None = None


def add_bars(spark: SparkSession, root: str, files: str, date: str) -> None:
    """Put the daily file of a session into the yearly bars."""
    store.add_sessions(raw.daily_bars(raw.csv_rows(spark, files), F.lit(date).cast("date")), f"{root}/daily")


def add_indices(spark: SparkSession, root: str, files: str, date: str) -> None:
    """Put the file of all indices of a session into the yearly index bars."""
    rows = raw.index_bars(raw.csv_rows(spark, files), F.lit(date).cast("date"))
    # a name that comes twice in a file keeps its higher close, so that keys are unique
    best = rows.groupBy("index_name", "date").agg(F.max(F.struct("close", "open", "high", "low")).alias("x"))
    store.add_sessions(best.select("index_name", "date", *[f"x.{c}" for c in ("open", "high", "low", "close")]), f"{root}/index_daily", "index_name")


def refresh_lists(spark: SparkSession, root: str, lists: dict[str, str]) -> None:
    """Replace the members of the indices that files are given for; other indices keep theirs."""
    new, path = raw.constituents(spark, lists), f"{root}/constituents"
    try:
        new = store.replace_session(curated.constituents(spark, path), new, key="index_name")
    except AnalysisException:
        pass  # no lists yet
    store.publish(new, path)


def refresh_actions(spark: SparkSession, root: str, files: str) -> None:
    """Take new filings in, verify all against the bars and publish the actions.

    A filing is its symbol, date and wording; one that comes again changes nothing.
    """
    new, path = raw.filings(spark, files), f"{root}/filings"
    try:
        new = spark.read.schema(new.schema).parquet(path).unionByName(new)
    except AnalysisException:
        pass  # no filings yet
    store.publish(new.distinct(), path)
    store.publish(corporate_actions(spark.read.parquet(path), curated.daily(spark, f"{root}/daily")), f"{root}/corporate_actions")


def _stored(read: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or no rows where it is not stored yet."""
    try:
        return read(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def delivered(spark: SparkSession, files: str | None) -> DataFrame | None:
    """Rows (symbol, delivery_pct), one a symbol, of a delivery file if there is one."""
    return raw.deliveries(spark, files).groupBy("symbol").agg(F.max("delivery_pct").alias("delivery_pct")) if files else None


def shot_of(spark: SparkSession, root: str, benchmarks: tuple[str, ...] = MARKET, delivery: DataFrame | None = None) -> Snapshot:
    """The snapshot of the stored tables."""
    return snapshot(
        curated.daily(spark, f"{root}/daily"), _stored(curated.actions, spark, f"{root}/corporate_actions", schemas.ACTIONS),
        _stored(curated.constituents, spark, f"{root}/constituents", schemas.CONSTITUENTS),
        _stored(curated.index_daily, spark, f"{root}/index_daily", f"{schemas.INDEX_DAILY}, year int"), delivery, benchmarks,
    )


def publish(
    spark: SparkSession, root: str, benchmarks: tuple[str, ...] = MARKET, delivery: DataFrame | None = None, notes: list[tuple[str, str, str]] | None = None
) -> int:
    """Compute the snapshot and publish all of its tables, the marks and the log at once; returns the version.

    ``notes`` are (job, status, detail) of the steps before, which enter the log with this one.
    """
    served, shot = serving.Served(spark, f"{root}/published"), shot_of(spark, root, benchmarks, delivery)
    day = curated.daily(spark, f"{root}/daily").where("close > 0").agg(F.max("date")).first()[0]
    if day is None:
        raise ValueError(f"{root}/daily has no traded bars, so there is no session to publish")
    now = dt.datetime.now(dt.timezone.utc)
    log = spark.createDataFrame([(now, job, day, status, detail) for job, status, detail in [*(notes or []), ("publish", "ok", "")]], LOG)
    meta = spark.createDataFrame([(key, str(day)) for key in ("last_analytics_date", "last_ingested_session")], "key string, value string")
    version = serving.publish_session(
        served, shot.stocks, shot.sectors.withColumn("date", F.lit(day).cast("date")), shot.history.drop("sess"), shot.candles,
        shot.index_rows.select("index_name", "date", "open", "high", "low", "close"), log, meta,
    )
    served.clean()
    return version


def run(spark: SparkSession, root: str, date: str, files: Files, benchmarks: tuple[str, ...] = MARKET) -> int:
    """One night.  Lists and filings that cannot be read leave the stored ones in use, and the log says so; bars must come."""
    notes: list[tuple[str, str, str]] = []

    def attempt(job: str, step: Callable[[], None]) -> None:
        try:
            step()
            notes.append((job, "ok", ""))
        except Exception as why:  # noqa: BLE001 - old lists and actions are better than no session
            notes.append((job, "failed", str(why).partition("\n")[0][:500]))

    if files.lists:
        attempt("reference", lambda: refresh_lists(spark, root, files.lists))
    add_bars(spark, root, files.daily, date)
    notes.append(("backfill", "ok", date))
    if files.indices:
        attempt("indices", lambda: add_indices(spark, root, files.indices, date))
    if files.filings:
        attempt("actions", lambda: refresh_actions(spark, root, files.filings))
    return publish(spark, root, benchmarks, delivered(spark, files.delivery), notes)
