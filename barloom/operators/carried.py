"""State that is carried from session to session, so that a new one does not read the history.

Averages keep their last value a symbol, all-time highs one row a symbol and year.  Both hold
a mark of the actions that they were made with; symbols whose marks no longer fit are made
again from their bars, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.adjust import adjusted_bars, applied, with_later_factor
from barloom.operators.indicators import PERIODS, with_emas

def _or_none(mark: str) -> Column:
    """The mark, or that of no actions."""
    return F.coalesce(mark, F.lit(0).cast("decimal(38,0)"))



def _mark() -> Column:
    """An aggregate that tells sets of actions apart."""
    return F.sum(F.xxhash64("ex_date", "factor").cast("decimal(20,0)")).cast("decimal(38,0)")


def marks(actions: DataFrame) -> DataFrame:
    """Rows (symbol, mark) of the applied actions."""
    return applied(actions).groupBy("symbol").agg(_mark().alias("mark"))


def _unlike(rows: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The symbols of rows whose ``mark`` differs from the one that ``now`` has for them."""
    fresh = rows.join(now.withColumnRenamed("mark", "_now"), keys, "left")
    return fresh.where(F.col("mark") != _or_none("_now")).select("symbol").distinct()


# --- all-time highs --------------------------------------------------------------------------


def yearly_highs(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows (symbol, year, ath, ath_date, since, mark): the highs of each year, by the prices of now."""
    rows = adjusted_bars(bars, actions).where("high > 0")
    first = F.max_by("date", F.struct("high", -F.unix_date("date")))
    by = rows.groupBy("symbol", F.year("date").alias("year")).agg(F.max("high").alias("ath"), first.alias("ath_date"), F.min("date").alias("since"))
    return by.join(marks(actions), "symbol", "left").withColumn("mark", _or_none("mark"))


def carried_highs(highs: DataFrame, bars: DataFrame, actions: DataFrame, year: int) -> DataFrame:
    """The yearly highs once ``year`` has new bars, or actions have come.

    ``highs`` are those made before; of ``bars``, which has a column ``year``, that year is
    read, and earlier ones for symbols whose actions have changed.
    """
    closed = highs.where(F.col("year") < year)
    changed = _unlike(closed, marks(actions), ["symbol"])
    kept = closed.join(changed, "symbol", "left_anti")
    again = bars.where(F.col("year") < year).join(F.broadcast(changed), "symbol", "left_semi")  # some thousands of symbols at most
    fresh = yearly_highs(bars.where(F.col("year") >= year), actions)
    return kept.select(*fresh.columns).unionByName(fresh).unionByName(yearly_highs(again, actions))


def merged_highs(highs: DataFrame) -> DataFrame:
    """Rows (symbol, ath, ath_date, since) of the yearly ones."""
    first = F.max_by("ath_date", F.struct("ath", -F.unix_date("ath_date")))
    return highs.groupBy("symbol").agg(F.max("ath").alias("ath"), first.alias("ath_date"), F.min("since").alias("since"))


# --- averages --------------------------------------------------------------------------------


def _marks_until(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows (symbol, date, mark): the actions with an ex-date up to each row's date."""
    some = rows.select("symbol", "date").distinct().join(applied(actions), "symbol").where(F.col("ex_date") <= F.col("date"))
    return some.groupBy("symbol", "date").agg(_mark().alias("mark"))


def averages_state(bars: DataFrame, actions: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Rows (symbol, date, mark, period, value): each average at a symbol's last bar, by the prices of that day."""
    rows = with_emas(adjusted_bars(bars, actions), periods, order="date")
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("date", "k", *[f"e{p}" for p in periods]), "date").alias("x"))
    # k leaves the prices of now; times k they are those of the bar's own day
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("period"), (F.col(f"x.e{p}") * F.col("x.k")).alias("value")) for p in periods]))
    state = last.select("symbol", F.col("x.date").alias("date"), each)
    return state.join(_marks_until(state, actions), ["symbol", "date"], "left").withColumn("mark", _or_none("mark")).select("symbol", "date", "mark", "period", "value")


def carried_averages(state: DataFrame, session: DataFrame, bars: DataFrame, actions: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """The state after one more session.

    ``session`` has the raw bars of one date behind all of the state.  Averages are brought to
    that day's prices, take its close in, and stay as they are where there is none.  ``bars``,
    the history with that session, is read for symbols whose actions up to the state's date
    have changed.
    """
    changed = F.broadcast(_unlike(state, _marks_until(state, actions), ["symbol", "date"]))  # some thousands of symbols at most
    held = state.join(changed, "symbol", "left_anti")
    new = session.where("close > 0").select("symbol", F.col("date").alias("_date"), "close").join(changed, "symbol", "left_anti")
    new = new.withColumn("period", F.explode(F.lit(list(periods))))
    joined = held.join(new, ["symbol", "period"], "full_outer")
    # what comes between the state's date and the session: later factors then less later factors now
    then = with_later_factor(joined.withColumn("_at", F.coalesce("date", "_date")), actions, "_at").withColumnRenamed("k", "_then")
    now = with_later_factor(then.withColumn("_to", F.coalesce("_date", "_at")), actions, "_to").withColumnRenamed("k", "_now")
    value = F.col("value") * F.col("_now") / F.col("_then")
    folded = F.when(F.col("value").isNull(), F.col("close")).when(F.col("_date").isNull(), F.col("value"))
    folded = folded.otherwise(value + (F.col("close") - value) * (F.lit(2.0) / (F.col("period") + 1)))
    out = now.select("symbol", F.col("_to").alias("date"), "period", folded.alias("value"))
    out = out.join(_marks_until(out, actions), ["symbol", "date"], "left").withColumn("mark", _or_none("mark"))
    again = averages_state(bars.join(changed, "symbol", "left_semi"), actions, periods)
    return out.select(*again.columns).unionByName(again)


def current_averages(state: DataFrame, actions: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Rows (symbol, date, e<period>...), by the prices of now."""
    rows = with_later_factor(state, actions).withColumn("value", F.col("value") / F.col("k"))
    return rows.groupBy("symbol", "date").agg(*[F.max(F.when(F.col("period") == p, F.col("value"))).alias(f"e{p}") for p in periods])


# --- what the lake holds -----------------------------------------------------------------------


def footer_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row (bars, first_date, last_date) of a yearly table, from the files' footers alone.

    It is planned in a session of its own, whose reader takes counts and extremes from the
    footers; in the caller's session nothing changes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = own.read.parquet(root)
    return rows.agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def yearly_holdings(bars: DataFrame) -> DataFrame:
    """Rows (year, symbol, part, days): for each symbol and year the days that it has bars on, as bits.

    A day is one bit of ``part``, a stretch of 32,768 days, so a row holds at most 4 kB.
    """
    day = F.unix_date("date")
    by = bars.groupBy(F.year("date").alias("year"), "symbol", F.bitmap_bucket_number(day).alias("part"))
    return by.agg(F.bitmap_construct_agg(F.bitmap_bit_position(day)).alias("days"))


def carried_holdings(held: DataFrame, bars: DataFrame, year: int) -> DataFrame:
    """The holdings once ``year`` has new bars; of ``bars``, which has a column ``year``, earlier years are not read."""
    fresh = yearly_holdings(bars.where(F.col("year") >= year))
    return held.where(F.col("year") < year).select(*fresh.columns).unionByName(fresh)


def held_coverage(held: DataFrame) -> DataFrame:
    """Rows (symbol, sessions): on how many days each symbol has bars."""
    parts = held.groupBy("symbol", "part").agg(F.bitmap_count(F.bitmap_or_agg("days")).alias("n"))
    return parts.groupBy("symbol").agg(F.sum("n").alias("sessions"))


def held_summary(held: DataFrame) -> DataFrame:
    """One row (symbols, sessions) of all holdings: the days' bits of all symbols are merged before they are counted."""
    parts = held.groupBy("part").agg(F.bitmap_count(F.bitmap_or_agg("days")).alias("n"))
    return held.agg(F.count_distinct("symbol").alias("symbols")).crossJoin(parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions")))  # one row each
