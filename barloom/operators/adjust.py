"""Split and bonus adjustment of bars.

A bar is divided by the product of the factors whose ex-date lies after it.  Bars and actions
go through one stream a symbol, from the last date to the first, and a running product is
carried from the actions to the bars: an as-of join by one sort, whose cost does not depend on
the number of actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_FACTOR, MOST_FACTOR = 0.05, 20.0


def applied(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("applied") & F.col("factor").between(LEAST_FACTOR, MOST_FACTOR))


def total_factors(actions: DataFrame) -> DataFrame:
    """Rows (symbol, total): the product of a symbol's applied factors."""
    return applied(actions).groupBy("symbol").agg(F.exp(F.sum(F.log("factor"))).alias("total"))


def running_factors(actions: DataFrame) -> DataFrame:
    """Rows (symbol, ex_date, running): the product of the factors up to each ex-date."""
    order = W.partitionBy("symbol").orderBy("ex_date").rowsBetween(W.unboundedPreceding, 0)
    return applied(actions).select("symbol", "ex_date", F.exp(F.sum(F.log("factor")).over(order)).alias("running"))


def with_later_factor(rows: DataFrame, actions: DataFrame, date: str = "date") -> DataFrame:
    """Add ``k``: the product of a symbol's applied factors with an ex-date after the row's date; 1 where there are none."""
    marks = applied(actions).select("symbol", F.col("ex_date").alias(date), F.col("factor").alias("_factor"), F.lit(True).alias("_mark"))
    stream = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # an action counts for the rows of earlier dates only, so of one date it comes behind them
    later = W.partitionBy("symbol").orderBy(F.desc(date), "_mark").rowsBetween(W.unboundedPreceding, 0)
    carried = stream.withColumn("k", F.coalesce(F.product("_factor").over(later), F.lit(1.0)))
    return carried.where(~F.col("_mark")).select(*rows.columns, "k")


def adjusted_bars(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with prices divided and volume multiplied by ``k``; traded value stays."""
    rows = with_later_factor(bars.where("close > 0"), actions)
    prices = {c: F.col(c) / F.col("k") for c in ("open", "high", "low", "close")}
    return rows.withColumns(prices | {"volume": F.col("volume") * F.col("k")})


def all_time_highs(adjusted: DataFrame) -> DataFrame:
    """Rows (symbol, ath, ath_date, since): the highest high, its first date, the first bar."""
    first = F.max_by("date", F.struct("high", -F.unix_date("date")))
    return adjusted.where("high > 0").groupBy("symbol").agg(F.max("high").alias("ath"), first.alias("ath_date"), F.min("date").alias("since"))
