"""The session axis: dates become gap-free numbers, and lags count sessions, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_bar_a_day(bars: DataFrame) -> DataFrame:
    """One row for each symbol and date: the series with most volume, then the first by name."""
    if "series" not in bars.columns:
        return bars
    order = W.partitionBy("symbol", "date").orderBy(F.desc("volume"), "series")
    return bars.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def session_axis(bars: DataFrame) -> DataFrame:
    """Rows (date, sess): one row a trading day, numbered from 0.

    There are a few hundred trading days a year however many bars there are, so this table
    alone may go through one task.
    """
    return bars.select("date").distinct().withColumn("sess", F.row_number().over(W.orderBy("date")) - 1)


def on_axis(bars: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Add ``sess``.  The axis is broadcast: it is bounded by the calendar."""
    return bars.join(F.broadcast(axis if axis is not None else session_axis(bars)), "date")


def along() -> W:
    return W.partitionBy("symbol").orderBy("sess")


def lag_of(column: str, sessions: int) -> Column:
    """The value of exactly that many sessions ago; null if the symbol did not trade then."""
    return F.max(column).over(along().rangeBetween(-sessions, -sessions))


def window_start(bars: DataFrame, sessions: int = 520) -> DataFrame:
    """One row: the first date of the last ``sessions`` trading days."""
    last = bars.select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    return last.agg(F.min("date").alias("start"))


def last_sessions(bars: DataFrame, sessions: int) -> DataFrame:
    """Bars of the last ``sessions`` trading days."""
    return since(bars, window_start(bars, sessions))


def since(bars: DataFrame, start: DataFrame) -> DataFrame:
    """Bars from the one date of ``start`` on.

    The date is a scalar subquery, so the filter reaches the scan and, where the bars have a
    ``year``, prunes its folders.
    """
    first = start.scalar()
    rows = bars.where(F.col("date") >= first)
    return rows.where(F.col("year") >= F.year(first)) if "year" in bars.columns else rows


def latest(rows: DataFrame, date: str = "date") -> DataFrame:
    """The rows of the last date in the table."""
    return rows.where(F.col(date) == rows.agg(F.max(date)).scalar())


def calendar(dates: DataFrame, start: Column, end: Column) -> DataFrame:
    """Weekdays from ``start`` to ``end`` for each row of ``dates``."""
    days = dates.select(F.explode(F.sequence(start, end)).alias("date"))
    return days.where(~F.dayofweek("date").isin(1, 7))
