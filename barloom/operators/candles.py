"""Chart payloads: column arrays of the last bars, index strips, stops and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDLES = 500
# Display names of the indices and the names that their file has.
INDEX_NAMES = {
    "NIFTY 50": "NIFTY 50", "NIFTY BANK": "NIFTY BANK", "NIFTY MIDCAP 100": "NIFTY MIDCAP 100",
    "NIFTY SMLCAP 100": "NIFTY SMALLCAP 100", "NIFTY IT": "NIFTY IT", "INDIA VIX": "INDIA VIX",
}


def tail_rows(bars: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """The last ``n`` rows of each key."""
    back = W.partitionBy(*keys).orderBy(F.desc(order))
    return bars.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def candle_payload(bars: DataFrame, n: int = CANDLES) -> DataFrame:
    """Rows (symbol, d, o, h, l, c, v): the last ``n`` bars of each symbol as arrays in date order."""
    bar = F.struct(
        F.col("date"),
        *[F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.col("volume").cast("long"), F.lit(0)).cast("long").alias("volume"),
    )
    rows = tail_rows(bars, n).groupBy("symbol").agg(F.sort_array(F.collect_list(bar)).alias("_b"))
    part = lambda name: F.transform("_b", lambda x: x[name])
    return rows.select(
        "symbol",
        F.transform("_b", lambda x: x["date"].cast("string")).alias("d"),
        *[part(name).alias(short) for name, short in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))],
    )


def candle_tail(payload: DataFrame, symbol: str, n: int | None = None) -> DataFrame:
    """Rows (i, d, o, h, l, c, v): the last ``n`` candles (180, at most 500) of one symbol."""
    n = max(0, min(CANDLES, 180 if n is None else n))
    zipped = F.arrays_zip("d", "o", "h", "l", "c", "v")
    tail = F.slice(zipped, F.greatest(F.lit(1), F.size(zipped) - n + 1), F.lit(n))
    return payload.where(F.col("symbol") == symbol).select(F.posexplode(tail).alias("i", "_x")).select("i", "_x.*")


def index_series(index_bars: DataFrame) -> DataFrame:
    """Rows (index_name, dates, opens, highs, lows, closes): every index as arrays in date order."""
    fields = [c for c in ("open", "high", "low", "close") if c in index_bars.columns]
    rows = index_bars.groupBy("index_name").agg(F.sort_array(F.collect_list(F.struct("date", *fields))).alias("_b"))
    part = lambda name: F.transform("_b", lambda x: x[name])
    gathered = [part(c).alias(f"{c}s") for c in fields]
    return rows.select("index_name", F.transform("_b", lambda x: x["date"].cast("string")).alias("dates"), *gathered)


def served_candles(payload: DataFrame, index_bars: DataFrame, symbol: str, n: int | None = None, names: dict[str, str] = INDEX_NAMES) -> DataFrame:
    """One row (sym, known, candles): the last ``n`` candles (180, at most 500) of a symbol or of an index by its display name.

    Candles of an index have volume 0.  A symbol without a payload is not ``known`` and has none.
    """
    symbol, n = symbol.upper(), max(0, min(CANDLES, 180 if n is None else n))
    if symbol in names:
        rows = index_bars.where(F.col("index_name") == names[symbol]).orderBy(F.desc("date")).limit(n)
        candle = F.struct(F.col("date").cast("string").alias("d"), *[F.col(c).alias(c[0]) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("v"))
        return rows.agg(F.sort_array(F.collect_list(candle)).alias("candles")).select(F.lit(symbol).alias("sym"), F.lit(True).alias("known"), "candles")
    zipped = F.arrays_zip("d", "o", "h", "l", "c", "v")
    own = payload.where(F.col("symbol") == symbol).select(F.slice(zipped, F.greatest(F.lit(1), F.size(zipped) - n + 1), F.lit(n)).alias("candles"))
    return own.agg(F.first("candles").alias("candles")).select(F.lit(symbol).alias("sym"), F.col("candles").isNotNull().alias("known"), "candles")


def index_strip(index_bars: DataFrame, names: DataFrame, points: int = 32) -> DataFrame:
    """Rows (display, value, chg_pct, pts) for the indices of ``names`` (display, index_name) that have bars."""
    wanted = index_bars.join(F.broadcast(names), "index_name")  # the strip is a short fixed list
    rows = tail_rows(wanted, points + 1, ("index_name",)).groupBy("display").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("_c")
    )
    value, before = F.element_at("_c", -1), F.get(F.col("_c"), F.size("_c") - 2)
    prev = F.coalesce(before, value)
    chg = F.when(prev > 0, F.try_divide(value, prev) * 100 - 100).otherwise(F.lit(0.0))
    pts = F.slice("_c", F.greatest(F.lit(1), F.size("_c") - points + 1), F.lit(points))
    return rows.select("display", value.alias("value"), chg.alias("chg_pct"), pts.alias("pts"))


def position_plan(bars: DataFrame, capital: float = 1e6, risk_pct: float = 1.0) -> DataFrame:
    """Rows (symbol, price, stop, qty, value, pct, stop_pct): size by the stop under the lows of ten bars."""
    rows = tail_rows(bars, 10).groupBy("symbol").agg(F.max_by("close", "date").alias("price"), (F.min("low") * 0.995).alias("stop"))
    risk = capital * risk_pct / 100
    qty = F.greatest(F.lit(0), F.floor(F.lit(risk) / F.greatest(F.lit(0.01), F.col("price") - F.col("stop"))))
    return rows.withColumn("qty", qty).select(
        "symbol", "price", "stop", "qty",
        (F.col("qty") * F.col("price")).alias("value"),
        (F.col("qty") * F.col("price") / capital * 100).alias("pct"),
        F.try_divide((F.col("price") - F.col("stop")) * 100.0, F.col("price")).alias("stop_pct"),
    )


def above_averages(last: Column, averages: dict[str, Column]) -> dict[str, Column]:
    """Whether the last close is at or above each average."""
    return {name: last >= average for name, average in averages.items()}


def day_change(last: Column, before: Column) -> Column:
    return F.when(before > 0, F.try_divide(last - before, before) * 100).otherwise(F.lit(0.0))
