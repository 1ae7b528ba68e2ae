"""The market snapshot: one lazy plan from bars, actions and indices to the published tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.categories import market_open, pad_left
from barloom.operators import actions as act
from barloom.operators import adjust, audit, breadth, candles, indicators, metrics, screens, sessions

WINDOW, HISTORY, SERIES = 520, 120, 45
#: Sessions that index bars are read for.
INDEX_SESSIONS = 260
BENCHMARKS = ("ALL",)


@dataclass
class Snapshot:
    """Lazy relations that share the adjusted bars."""

    adjusted: DataFrame
    axis: DataFrame
    indicators: DataFrame
    stocks: DataFrame
    sectors: DataFrame
    history: DataFrame
    candles: DataFrame
    indices: DataFrame
    #: The rows that ``indices`` are made of.
    index_rows: DataFrame


def corporate_actions(
    filings: DataFrame, bars: DataFrame, order: tuple[str, ...] = ("source_ex_date", "subject"), keys: tuple[str, ...] | None = None
) -> DataFrame:
    return act.dedup_actions(act.verify_actions(filings, bars, keys), order)


def snapshot(
    bars: DataFrame, actions: DataFrame, constituents: DataFrame, index_bars: DataFrame,
    delivery: DataFrame | None = None, benchmarks: tuple[str, ...] = BENCHMARKS, window: int = WINDOW, history: int = HISTORY,
) -> Snapshot:
    """The whole nightly computation; nothing runs until a relation is written or collected."""
    daily = sessions.one_bar_a_day(bars).where("close > 0")
    adjusted = adjust.adjusted_bars(daily, actions)
    # start and axis are found on the raw dates; actions before the start do not matter to the bars behind it
    traded = bars.where("close > 0")
    start = sessions.window_start(traded, window)
    recent = adjust.adjusted_bars(sessions.since(daily, start), actions)
    axis = sessions.session_axis(sessions.since(traded, start))
    with_all = breadth.with_indicators(sessions.on_axis(recent, axis), window)
    indices = sessions.since(index_bars, axis.orderBy(F.desc("sess")).limit(INDEX_SESSIONS).agg(F.min("date").alias("start")))
    bench = indicators.benchmark_ratio(indices, benchmarks)
    stocks = metrics.stock_metrics(with_all, adjust.all_time_highs(adjusted), metrics.sector_of(constituents), bench, delivery)
    # symbols of the last session, which need no indicators
    active = recent.join(sessions.latest(traded).select("symbol").distinct(), "symbol", "left_semi")
    return Snapshot(
        adjusted, axis, with_all, stocks, metrics.sector_scores(stocks), breadth.breadth_history(with_all, axis, history),
        candles.candle_payload(active), candles.index_series(indices), indices,
    )


def _tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), F.lit(n))


def summary(shot: Snapshot, strip: DataFrame, flows: DataFrame) -> DataFrame:
    """One row with the nested payload that the dashboard reads.

    The history is at most 120 rows, sectors and the strip a few dozen; the stocks of one
    session (a few thousand) are gathered as one array, as the payload demands.
    """
    hist = breadth.with_percentages(shot.history)
    gather = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("sess", c))), lambda x: x[c])
    series = ("new_highs", "new_lows", "up20", "up30", "vol_up4", "vol_dn4")
    spread = hist.withColumns({"ad": F.col("advances") - F.col("declines"), "nh": F.col("new_highs") - F.col("new_lows")})
    last = lambda c: F.max_by(c, "sess")
    total = last("advances") + last("declines")
    part = spread.agg(
        last("date").alias("date"),
        *[last(c).alias(c) for c in ("advances", "declines", "unchanged", "new_highs", "new_lows")],
        F.struct(*[last(f"pct{p}").alias(f"e{p}") for p in (10, 20, 50, 200)]).alias("ema_vals"),
        F.struct(*[gather(f"pct{p}").alias(f"e{p}") for p in (20, 50, 200)]).alias("ema_hist"),
        pad_left(gather("ad").cast("array<double>"), 90).alias("ad_daily"),
        pad_left(gather("nh").cast("array<double>"), 90).alias("nh_daily"),
        F.struct(*[_tail(gather(c), SERIES).alias(c) for c in series]).alias("series"),
        last("vol_up4").alias("vol_up"),
        last("vol_dn4").alias("vol_dn"),
        gather("date").cast("array<string>").alias("dates"),
        F.when(total > 0, F.try_divide((last("advances") - last("declines")).cast("double"), total)).otherwise(F.lit(0.0)).alias("avg_bias"),
    )
    served = ("sym", "sector", "price", "chg1d", "chg1w", "dist_ath", "is_ath", "is52", "wk_break", "ath_since")
    stocks = shot.stocks.agg(
        F.count("*").alias("universe"), F.count_if("is_ath").alias("ath_count"), F.sort_array(F.collect_list(F.struct(*served))).alias("stocks")
    )
    names = [c for c in shot.sectors.columns if c != "score"]
    sectors = shot.sectors.agg(F.sort_array(F.collect_list(F.struct("score", *names)), asc=False).alias("sectors"))
    indices = strip.agg(F.sort_array(F.collect_list(F.struct("display", "value", "chg_pct", "pts"))).alias("indices"))
    tail = screens.flow_tail(screens.normal_flows(flows))
    of = lambda side: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("category") == side, F.struct("date", "net")))), lambda x: x["net"]
    )
    days = F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == "FII", F.col("date")))), lambda x: x.cast("string"))
    money = tail.agg(F.struct(pad_left(of("FII"), 20).alias("fii"), pad_left(of("DII"), 20).alias("dii")).alias("flows"), _tail(days, 20).alias("flow_dates"))
    # no published session, no row
    part = part.where("date is not null")
    return part.crossJoin(stocks).crossJoin(sectors).crossJoin(indices).crossJoin(money)  # one row each


def status(stocks: DataFrame, meta: DataFrame, log: DataFrame, now: Column, rows: int = 25) -> DataFrame:
    """One row: whether the market is open, the stored marks, what is served, and the newest log rows.

    ``meta`` has (key, value), ``log`` (ts, job, date, status, detail).
    """
    mark = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    marks = meta.agg(mark("last_ingested_session").alias("last_ingested_session"), mark("last_analytics_date").alias("last_analytics_date"))
    served = stocks.agg(F.count("*").alias("rows"), F.count_distinct("date").alias("sessions"))
    newest = audit.recent_log(log, rows).agg(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "job", "date", "status", "detail")))).alias("recent_log"))
    return marks.crossJoin(served).crossJoin(newest).withColumn("market_open", market_open(now))  # one row each
