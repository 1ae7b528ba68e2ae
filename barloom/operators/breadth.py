"""Breadth: counts over all symbols for each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.numbers import percent_of
from barloom.operators.indicators import PERIODS, WEEK, with_emas, with_grid

HISTORY = 120


def with_indicators(bars: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Bars on the session axis with grid columns and averages; ``most_rows`` as for ``with_emas``."""
    return with_emas(with_grid(bars), most_rows=most_rows)


def breadth_counters(indicators: DataFrame) -> DataFrame:
    """Rows (sess, date, counted, advances, ...): only symbols with a bar in the session before count."""
    valid = indicators.where("prev > 0")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    chg, close = F.col("chg"), F.col("close")
    week = F.try_divide(close, F.when(F.col("close5") > 0, F.col("close5"))) * 100.0 - 100.0
    surge = (F.col("vol20") > 0) & (F.col("volume") > F.col("vol20"))
    return valid.groupBy("sess", "date").agg(
        F.count("*").alias("counted"),
        count(chg > 0.0001).alias("advances"),
        count(chg < -0.0001).alias("declines"),
        count(F.abs(chg) <= 0.0001).alias("unchanged"),
        count((F.col("hi52") > 0) & (F.col("high") >= F.col("hi52"))).alias("new_highs"),
        count(F.col("low") <= F.col("lo52")).alias("new_lows"),
        *[count(close > F.col(f"e{p}")).alias(f"above{p}") for p in PERIODS],
        count((F.col("sess") >= WEEK) & (week >= 20)).alias("up20"),
        count((F.col("sess") >= WEEK) & (week >= 30)).alias("up30"),
        count(surge & (chg >= 4)).alias("vol_up4"),
        count(surge & (chg <= -4)).alias("vol_dn4"),
    )


def breadth_history(indicators: DataFrame, axis: DataFrame, sessions: int = HISTORY) -> DataFrame:
    """The counters of the last ``sessions`` sessions; sessions without a countable symbol have zeros."""
    last = axis.orderBy(F.desc("sess")).limit(sessions)
    counted = breadth_counters(indicators).drop("date")
    return last.join(counted, "sess", "left").na.fill(0)


def with_percentages(history: DataFrame) -> DataFrame:
    """Add the per cent of counted symbols above each average."""
    return history.withColumns({f"pct{p}": percent_of(F.col(f"above{p}"), F.col("counted")) for p in PERIODS})


def tails(history: DataFrame, sessions: int = 45) -> DataFrame:
    """Net highs and advances for the last ``sessions`` rows of the history."""
    rows = history.orderBy(F.desc("sess")).limit(sessions)
    return rows.select(
        "date", (F.col("new_highs") - F.col("new_lows")).alias("net_hl"), (F.col("advances") - F.col("declines")).alias("ad")
    )


def up_and_down(series: DataFrame, value: str, sessions: int) -> DataFrame:
    """One row about the last ``sessions`` values: days up and down, mean, last, change since the first."""
    rows = series.orderBy(F.desc("date")).limit(sessions)
    last, first = F.max_by(value, "date"), F.min_by(value, "date")
    return rows.agg(
        F.count_if(F.col(value) > 0).alias("up_days"),
        F.count_if(~(F.col(value) > 0)).alias("down_days"),
        F.avg(value).alias("mean"),
        last.alias("last"),
        (last - first).alias("delta"),
    )


def ath_count(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count_if("is_ath").alias("ath_count"))
