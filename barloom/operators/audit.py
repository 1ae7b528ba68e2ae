"""Audits: coverage, derived figures, what surrounds an ex-date, an independent copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def lake_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count("*").alias("bars"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("date").alias("sessions"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def symbol_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("sessions")
    )


def derived_stats(adjusted: DataFrame) -> DataFrame:
    """Highs and lows of each symbol; the year counts back from the last date of all symbols."""
    last = adjusted.agg(F.max("date").alias("_last"))
    rows = adjusted.crossJoin(F.broadcast(last)).withColumn("_year", F.col("date") >= F.date_sub("_last", 365))  # one row
    return rows.groupBy("symbol").agg(
        F.max("high").alias("ath"),
        F.max(F.when(F.col("_year"), F.col("high"))).alias("hi52"),
        F.min(F.when(F.col("_year"), F.col("low"))).alias("lo52"),
        F.max_by("close", "date").alias("last_close"),
        F.max("date").alias("last_date"),
    )


def around_ex_dates(adjusted: DataFrame, raw: DataFrame, actions: DataFrame, days: int = 5) -> DataFrame:
    """Raw and adjusted closes within ``days`` of each verified ex-date, with the adjusted change."""
    ex = actions.where("status = 'verified'").select("symbol", "ex_date")
    near = adjusted.join(ex, "symbol").where(F.col("date").between(F.date_sub("ex_date", days), F.date_add("ex_date", days)))
    joined = near.select("symbol", "ex_date", "date", F.col("close").alias("adj_close"), "k").join(
        raw.select("symbol", "date", F.col("close").alias("raw_close")), ["symbol", "date"]
    )
    before = F.lag("adj_close").over(W.partitionBy("symbol", "ex_date").orderBy("date"))
    return joined.withColumn("step", (F.try_divide(F.col("adj_close"), before) - 1) * 100)


def cross_check(ours: DataFrame, theirs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows (symbol, date, field, ours, theirs, ok) for bars that both publications hold."""
    joined = ours.alias("a").join(theirs.alias("b"), ["symbol", "date"])
    each = [F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("double").alias("ours"), F.col(f"b.{f}").cast("double").alias("theirs")) for f in fields]
    rows = joined.select("symbol", "date", F.inline(F.array(*each)))
    allowed = F.greatest(F.lit(0.01), F.abs("theirs") * 1e-6)
    ok = (F.col("theirs") != 0) & (F.abs(F.col("ours") - F.col("theirs")) <= allowed)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def recent_log(log: DataFrame, rows: int = 25) -> DataFrame:
    """The newest log rows."""
    return log.orderBy(F.desc("ts"), "job", "detail").limit(rows)


def raw_tail(bars: DataFrame, symbol: str, n: int = 8) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).orderBy(F.desc("date")).limit(n)
