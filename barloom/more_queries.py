"""More registered queries: trends at their highs, long averages, sorts, the served entries, and files written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import categories as cat
from barloom.operators import actions as act
from barloom.operators import candles, carried, indicators, metrics, news, screens, serving, sessions, store, watchlist
from barloom.plans import nightly
from barloom.plans.snapshot import snapshot, status, summary
from barloom.queries import CTES, Inputs, _r, _rounded, query
from barloom.sources import curated, raw


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes: in the shared checkpoint folder, which tests may leave unset."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barloom-files-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


# --- trends: every kind of high ---------------------------------------------------------------

CTES["trend_facts"] = """select t.symbol as sym, coalesce(s.industry, 'Other') as sector, max(t.close) filter (back = 1) as price, max(t.high) as ath,
  max(t.high) filter (back <= 252) as hi52, max(t.close) filter (back = 6) as before
  from (select *, row_number() over (partition by symbol order by date desc) as back from trend) t left join sectors s using (symbol) group by 1, 2"""
CTES["trend_flags"] = """select *, (ath - price) / ath * 100 < 0.4 as is_ath, (hi52 - price) / hi52 * 100 < 0.5 as is52,
  (hi52 - price) / hi52 * 100 >= 0.5 and (price / before - 1) * 100 > 3.5 and (hi52 - price) / hi52 * 100 < 6 as wk_break from trend_facts"""


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    nothing = given.actions().where(F.lit(False))
    return given.stored("trend_stocks", lambda: snapshot(given("trend"), nothing, given("sectors"), given("index_bars")).stocks)


@query("select count(*) filter (is_ath) as ath, count(*) filter (is52) as w52, count(*) filter (wk_break) as wk from trend_flags")
def trend_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.pool_sizes(_trend(spark, sf_dir))


def _trend_screen(mode: str, flag: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return screens.highs_screen(_trend(spark, sf_dir), mode).select("sym", "sector", _r("price"))

    run.__name__ = f"trend_screen_{mode}"
    query(f"select sym, sector, round(price, 4) as price from trend_flags where {flag}")(run)


for _mode, _flag in screens.HIGH_MODES.items():
    _trend_screen(_mode, _flag)


@query("select sym, price from trend_flags where is52 and sector = 'ASIA'")
def trend_screen_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.highs_screen(_trend(spark, sf_dir), "w52", "ASIA").select("sym", "price")


@query("select sector, count(*) as stocks from trend_flags where is52 group by 1")
def trend_pool_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.pool_sectors(screens.highs_screen(_trend(spark, sf_dir), "w52"))


@query(
    "select sym, case when is_ath then 'ATH' when is52 then '52W' when wk_break then 'BREAKOUT' when (ath - price) / ath * 100 < 10 then 'NEAR HIGH' else 'OFF HIGHS' end as tag from trend_flags"
)
def trend_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.with_tags(_trend(spark, sf_dir)).select("sym", "tag")


# --- long averages ----------------------------------------------------------------------------


@query(
    "select symbol, unnest(range(1, len(a) + 1)) as n, "
    + ", ".join(f"floor(unnest({x}) * 1e4 + 0.5) / 1e4 as e{p}" for x, p in (("a", 10), ("b", 200)))
    + " from (select symbol, "
    + ", ".join(
        f"list_reduce(list([close] order by n), lambda e, x: list_append(e, e[-1] * (1 - 2.0::double / {p + 1}) + x[1] * (2.0::double / {p + 1}))) as {x}" for x, p in (("a", 10), ("b", 200))
    )
    + " from series where n <= 6000 group by symbol)"
)
def ema_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over 6,000 rows a symbol, more than one block of the closed form."""
    rows = indicators.with_emas(Inputs(spark, sf_dir)("series").where("n <= 6000"), (10, 200), order="n")
    return rows.select("symbol", "n", _r("e10"), _r("e200"))


# --- state that is carried on -----------------------------------------------------------------


def _lake(given: Inputs) -> DataFrame:
    """The bars in yearly folders, as a deployment stores them."""
    path = scratch(given.spark)
    store.write_years(given("bars"), path)
    return store.read_years(given.spark, path)


@query("select symbol, " + ", ".join(f"round(arg_max(e{p}, sess), 4) as e{p}" for p in indicators.PERIODS) + " from emas group by symbol")
def ema_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages at each symbol's last bar: a state without the last session and some of the actions, which then come."""
    given = Inputs(spark, sf_dir)
    bars, actions, path = _lake(given), given.actions(), scratch(spark)
    last = bars.agg(F.max("date")).first()[0]
    carried.averages_state(bars.where(F.col("date") < last), actions.where("g < 2 or symbol like '%7'")).write.parquet(path)
    session = bars.where((F.col("date") == last) & (F.col("year") == last.year))
    state = carried.carried_averages(spark.read.parquet(path), session, bars, actions)
    return carried.current_averages(state, actions).select("symbol", *[_r(f"e{p}") for p in indicators.PERIODS])


@query("select symbol, round(ath, 4) as ath, ath_date, since from highs")
def ath_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time highs from yearly ones: made before the last year and some of the actions, which then come."""
    given = Inputs(spark, sf_dir)
    bars, actions, path = _lake(given), given.actions(), scratch(spark)
    year = bars.agg(F.max("year")).first()[0]
    carried.yearly_highs(bars.where(F.col("year") < year), actions.where("g < 2 or symbol like '%7'")).write.parquet(path)
    highs = carried.carried_highs(spark.read.parquet(path), bars, actions, year)
    return carried.merged_highs(highs).select("symbol", _r("ath"), "ath_date", "since")


@query(
    "select symbol, ex_date, factor, kind, status, round(implied, 6) as implied, subject, source_ex_date, applied, g from verified"
)
def reverify_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings verified without the last 96 sessions, and again where these come near."""
    given = Inputs(spark, sf_dir)
    bars, path = _lake(given), scratch(spark)
    cut = sessions.window_start(bars, 96).first()[0]
    act.verify_actions(given("filings"), bars.where(F.col("date") < cut)).write.parquet(path)
    keys = ("symbol", "source_ex_date", "subject", "g")
    found = act.reverify(spark.read.parquet(path), given("filings"), bars, F.lit(cut), keys)
    return found.select("symbol", "ex_date", "factor", "kind", "status", _r("implied", 6), "subject", "source_ex_date", "applied", "g")


# --- sorts ------------------------------------------------------------------------------------

_KEYS = {"stocks": ("sym", "sector", "price", "chg1d", "chg1w", "dist_ath", "tag"), "sectors": ("name", "count", "adv", "dma_pct", "new_highs", "wk", "score")}


def _sort_sql(table: str, relation: str, name: str) -> str:
    first = {"sym": "asc", "sector": "asc", "name": "asc"} | ({"dist_ath": "asc"} if table == "stocks" else {})
    words = {"name": "sector", "adv": "adv / greatest(1, count)::double", "tag": "case when is_ath then 5 when is52 then 4 when wk_break then 3 when dist_ath < 10 then 2 else 1 end"}
    parts = [
        f"select '{k}' as key, place, name from (select {name} as name, cast(row_number() over (order by {words.get(k, k)} {first.get(k, 'desc')}, {name}) as bigint) as place from {relation}) where place <= 5"
        for k in _KEYS[table]
    ]
    return " union all ".join(parts)


def _sorted_tops(rows: DataFrame, table: str, name: str) -> DataFrame:
    path = scratch(rows.sparkSession)  # the rows of one session are made once, not once a sort
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    out = None
    for key in _KEYS[table]:
        top = screens.sort_table(rows, table, key).limit(5).agg(F.collect_list(name).alias("names"))
        part = top.select(F.lit(key).alias("key"), F.posexplode("names").alias("place", "name")).withColumn("place", (F.col("place") + 1).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_sort_sql("stocks", "flagged", "sym"))
def sorted_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_tops(screens.with_tags(Inputs(spark, sf_dir).stocks()), "stocks", "sym")


@query(_sort_sql("sectors", "scores", "sector"))
def sorted_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_tops(metrics.sector_scores(Inputs(spark, sf_dir).stocks()), "sectors", "sector")


# --- served entries ---------------------------------------------------------------------------


@query("select symbol, round(close, 4) as close from bars where date = (select max(date) from bars)")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest(Inputs(spark, sf_dir)("bars")).select("symbol", _r("close"))


@query(
    "select index_name, string_agg(cast(date as varchar), ',' order by date) as dates, count(*) as n, round(sum(open), 2) as opens, round(sum(high), 2) as highs, round(sum(low), 2) as lows, round(sum(close), 2) as closes "
    "from index_bars where date >= (select min(date) from (select date from axis order by date desc limit 260)) group by 1"
)
def index_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir).shot().indices
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rows.select("index_name", F.array_join("dates", ",").alias("dates"), F.size("closes").cast("long").alias("n"), *[_rounded(total(c), 2).alias(c) for c in ("opens", "highs", "lows", "closes")])


_NAMES = {"ASIA INDEX": "ASIA", "ALL SHARES": "ALL"}


@query(
    "select 'ASIA INDEX' as sym, true as known, 40::bigint as n, (select string_agg(cast(date as varchar), ',' order by date) from (select date from index_bars where index_name = 'ASIA' order by date desc limit 40)) as days, "
    "(select round(sum(high - low), 2) from (select high, low from index_bars where index_name = 'ASIA' order by date desc limit 40)) as spread, 0::bigint as volume "
    "union all select 'S0003', true, 60, (select string_agg(cast(date as varchar), ',' order by date) from (select date from adj where symbol = 'S0003' order by date desc limit 60)), null, "
    "(select sum(cast(trunc(volume) as bigint)) from (select volume from adj where symbol = 'S0003' order by date desc limit 60)) "
    "union all select 'NOBODY', false, null, null, null, null"
)
def candle_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    payload, index = candles.candle_payload(given.adjusted().where("symbol = 'S0003'")), given("index_bars")
    parts = [candles.served_candles(payload, index, name, n, _NAMES) for name, n in (("Asia Index", 40), ("S0003", 60), ("nobody", None))]
    total = lambda f: F.aggregate("candles", F.lit(0.0), lambda s, x: s + f(x))
    out = None
    for part in parts:
        row = part.select(
            "sym", "known", F.when(F.col("known"), F.size("candles").cast("long")).alias("n"), F.when(F.col("known"), F.array_join(F.transform("candles", lambda x: x["d"]), ",")).alias("days"),
            F.when(F.col("sym") == "ASIA INDEX", _rounded(total(lambda x: x["h"] - x["l"]), 2)).alias("spread"),
            F.when(F.col("known"), total(lambda x: x["v"].cast("double")).cast("long")).alias("volume"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "select s.rows, s.sessions, '2001-10-29' as last_ingested_session, isodow(timestamp '2024-01-03 10:00:00') <= 5 and 930 >= 10 * 60 + 330 - 0 and 10 * 60 + 330 <= 930 as market_open, "
    "(select string_agg(detail || ' ' || status, ',' order by ts desc, job desc, date desc, status desc, detail desc) from (select * from log order by ts desc, job, detail limit 25)) as newest from (select count(*) as rows, count(distinct date) as sessions from flagged) s"
)
def status_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    meta = spark.createDataFrame([("last_ingested_session", "2001-10-29"), ("other", "x")], "key string, value string")
    row = status(given.stocks(), meta, given("log"), F.lit("2024-01-03 10:00:00").cast("timestamp"))
    newest = F.array_join(F.transform("recent_log", lambda x: F.concat(x["detail"], F.lit(" "), x["status"])), ",")
    return row.select("rows", "sessions", "last_ingested_session", "market_open", newest.alias("newest"))


@query(
    "select cast(l.date as varchar) as date, l.vol_up4 as vol_up, l.vol_dn4 as vol_dn, (select string_agg(cast(date as varchar), ',' order by sess) from pcts) as dates, "
    "(select string_agg(cast(date as varchar), ',' order by date) from (select date from tail where category = 'FII' order by date desc limit 20)) as flow_dates, "
    "(select string_agg(cast(new_highs as varchar), ',' order by sess) from (select * from pcts order by sess desc limit 45)) as new_highs, "
    "(select string_agg(cast(up20 as varchar), ',' order by sess) from (select * from pcts order by sess desc limit 45)) as up20, "
    "(select string_agg(sym, ',' order by sym) from flagged) as stocks from (select * from pcts order by sess desc limit 1) l"
)
def summary_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    names = spark.createDataFrame([("All shares", "ALL")], "display string, index_name string")
    row = summary(given.shot(), candles.index_strip(given("index_bars"), names), given("flows"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return row.select(
        F.col("date").cast("string").alias("date"), "vol_up", "vol_dn", text("dates").alias("dates"), text("flow_dates").alias("flow_dates"),
        text("series.new_highs").alias("new_highs"), text("series.up20").alias("up20"), F.array_join(F.transform("stocks", lambda x: x["sym"]), ",").alias("stocks"),
    )


@query(
    "select 'all' as symbol, count(*) as articles from news union all select w.symbol, count(n.id) from watch w left join news n using (symbol) group by 1"
)
def news_symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    return news.symbol_counts(given("news"), given("watch"))


@query(
    "select date, cast(floor(coalesce(advances * 100.0 / nullif(advances + declines + unchanged, 0), 0) + 0.5) as bigint) as adv_width, "
    "cast(floor(coalesce(declines * 100.0 / nullif(advances + declines + unchanged, 0), 0) + 0.5) as bigint) as dec_width, "
    "round(greatest(0, least(100, new_highs * 100.0::double / 20)), 4) as meter, new_highs - new_lows >= 0 as rising from history"
)
def bars_and_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir).shot().history
    total = F.col("advances") + F.col("declines") + F.col("unchanged")
    return rows.select(
        "date", cat.bar_width(F.col("advances"), total).alias("adv_width"), cat.bar_width(F.col("declines"), total).alias("dec_width"),
        _rounded(cat.meter(F.col("new_highs"), F.lit(20.0)), 4).alias("meter"), cat.rising(F.col("new_highs") - F.col("new_lows")).alias("rising"),
    )


@query(
    "select sym, price >= e10 as e10, price >= e20 as e20, price >= e50 as e50, price >= e200 as e200, round(case when prev > 0 then (price - prev) / prev * 100 else 0 end, 4) as day_change "
    "from flagged join (select symbol as sym, prev from lagged where sess = (select max(sess) from axis)) using (sym)"
)
def average_pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = Inputs(spark, sf_dir).shot()
    before = sessions.latest(shot.indicators, "sess").select(F.col("symbol").alias("sym"), "prev")
    states = candles.above_averages(F.col("price"), {f"e{p}": F.col(f"e{p}") for p in indicators.PERIODS})
    return shot.stocks.join(before, "sym").select("sym", *[c.alias(n) for n, c in states.items()], _rounded(candles.day_change(F.col("price"), F.col("prev")), 4).alias("day_change"))


# --- watchlists -------------------------------------------------------------------------------


@query(
    "select user_id, symbol from (select 1::bigint as user_id, symbol from watch union select 2, symbol from watch union select 1, symbol from sectors where symbol like '%7') where not (user_id = 2 and symbol = 'S0003')"
)
def watch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Inputs(spark, sf_dir)
    users = spark.range(1, 3).withColumnRenamed("id", "user_id")
    held = given("watch").crossJoin(F.broadcast(users)).select("user_id", "symbol")  # two rows
    asked = given("sectors").where("symbol like '%7'").select(F.monotonically_increasing_id().alias("pos"), F.lower("symbol").alias("symbol"))
    return watchlist.remove(watchlist.add(held, 1, asked, most=100_000), 2, " s0003 ")


@query("select c_name, c_acctbal from customer where c_custkey = 7")
def lookup_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(Inputs(spark, sf_dir).table("customer"), c_custkey=7).select("c_name", "c_acctbal")


# --- files ------------------------------------------------------------------------------------


@query("select symbol, date, round(close, 4) as close, volume, year(date) as year from bars where date >= date '1999-03-01'")
def yearly_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files: written, written again with only the open year replaced, read from a date on."""
    bars, root = Inputs(spark, sf_dir)("bars"), scratch(spark)
    columns = ("series", "isin", "prev_close")
    full = bars.withColumns({c: F.lit(None).cast("double" if c == "prev_close" else "string") for c in columns})
    store.write_years(full.withColumn("close", F.when(F.year("date") == 2001, F.lit(-1.0)).otherwise(F.col("close"))), root)
    store.write_years(full, root, force=False)
    return curated.daily(spark, root, "1999-03-01").select("symbol", "date", _r("close"), "volume", F.col("year").cast("long").alias("year"))


@query("select index_name, date, round(close, 4) as close from index_bars where date >= date '2000-01-01'")
def yearly_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    store.write_years(Inputs(spark, sf_dir)("index_bars"), root, key="index_name")
    return curated.index_daily(spark, root, "2000-01-01").select("index_name", "date", _r("close"))


@query("select symbol, ex_date, factor, kind, status, applied from actions")
def published_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions published twice over rows that were read from the table itself."""
    rows, path = Inputs(spark, sf_dir).actions().drop("g"), scratch(spark)
    store.publish(rows.where("applied"), path)
    store.publish(spark.read.parquet(path).unionByName(rows.where("not applied")), path)
    return curated.actions(spark, path).select("symbol", "ex_date", "factor", "kind", "status", "applied")


@query("select index_name, symbol, industry from sectors")
def published_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    store.publish(Inputs(spark, sf_dir)("sectors"), path)
    return curated.constituents(spark, path).select("index_name", "symbol", "industry")


@query("select status, count(*) * 2 as rows from log group by 1")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = Inputs(spark, sf_dir)("log"), scratch(spark)
    for _ in range(2):
        store.append(rows, path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("rows"))


def _csv(rows: DataFrame) -> str:
    path = scratch(rows.sparkSession)
    rows.write.option("header", True).csv(path)
    return f"{path}/*.csv"


@query(
    "select symbol, date, 'EQ' as series, round(open, 4) as open, round(close, 4) as close, volume, trades from bars where symbol not like '%4'"
)
def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily files of both layouts; one date stands in for the change of layouts by an offset."""
    bars = Inputs(spark, sf_dir)("bars")
    series = F.when(F.col("symbol").like("%4"), "GB").otherwise("EQ")
    out = None
    for days, layout, where in ((0, "old", "date < date'2001-10-01'"), (10_000, "new", "date >= date'2001-10-01'")):
        names = raw.LAYOUTS[layout]
        values = {**{c: F.col(c) for c in ("symbol", "open", "high", "low", "close", "volume", "traded_value", "trades")}, "series": series, "isin": F.lit("X"), "prev_close": F.lit(0)}
        columns = [values[k].cast("string").alias(f" {v.upper()} ") for k, v in names.items()]
        path = _csv(bars.where(where).select(*columns, F.date_add("date", days).cast("string").alias("DAY")))
        day = F.try_element_at(F.col("row"), F.lit("day")).cast("date")
        part = raw.daily_bars(raw.csv_rows(spark, path), day).withColumn("date", F.date_sub("date", days))
        out = part if out is None else out.unionByName(part)
    return out.select("symbol", "date", "series", _r("open"), _r("close"), "volume", "trades")


@query("select index_name, date, round(close, 4) as close, round(high, 4) as high from index_bars")
def raw_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir)("index_bars")
    names = {"open": "Open Index Value", "high": "High Index Value", "low": "Low Index Value", "close": "Closing Index Value"}
    path = _csv(rows.select(F.initcap("index_name").alias("Index Name"), *[F.col(k).cast("string").alias(v) for k, v in names.items()], F.col("date").cast("string").alias("Day")))
    found = raw.index_bars(raw.csv_rows(spark, path), F.try_element_at(F.col("row"), F.lit("day")).cast("date"))
    return found.select("index_name", "date", _r("close"), _r("high"))


@query("select concat('P', cast(p_partkey as varchar)) as symbol, round(p_retailprice, 2) as close, cast(p_size as double) as delivery_pct from part")
def raw_security_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Inputs(spark, sf_dir).table("part")
    cells = {"SYMBOL": F.concat(F.lit("P"), F.col("p_partkey")), " SERIES": F.lit(" EQ"), " CLOSE_PRICE": F.concat(F.lit(" "), F.col("p_retailprice")), " DELIV_PER": F.concat(F.lit(" "), F.col("p_size"))}
    found = raw.security_report(raw.csv_rows(spark, _csv(part.select(*[c.alias(n) for n, c in cells.items()]))))
    return found.select("symbol", _r("close", 2), "delivery_pct")


@query("select concat('P', cast(p_partkey as varchar)) as symbol, cast(p_size as double) as delivery_pct from part where p_partkey % 3 <> 0")
def raw_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, path = Inputs(spark, sf_dir).table("part"), scratch(spark)
    series = F.when(F.col("p_partkey") % 3 == 0, "GB").otherwise("EQ")
    line = F.concat_ws(",", F.lit("20"), F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey")), series, F.lit("10"), F.lit("5"), F.col("p_size"))
    heads = spark.range(1).select(F.explode(F.array(F.lit("10,head,of,file"), F.lit("20,short"))).alias("value"))
    part.select(line.alias("value")).unionByName(heads).write.text(path)
    return raw.deliveries(spark, path)


def _json(rows: DataFrame) -> str:
    """Rows written as one JSON array a file, as the vendors do; rows of one file fit in a task."""
    path = scratch(rows.sparkSession)
    packs = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    packs.select("value").repartition(F.col("value")).write.text(path)
    return path


@query("select symbol, ex, trim(subject) as subject from filings")
def raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir)("filings").select(F.concat(F.lit(" "), F.col("symbol")).alias("symbol"), "subject", F.date_format("ex", "dd-MMM-yyyy").alias("exDate"))
    return raw.filings(spark, _json(rows.coalesce(1)))


@query("select 'A' as index_name, symbol, name, industry from sectors where symbol like '%1' union all select 'B', symbol, name, industry from sectors where symbol like '%2'")
def raw_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir)("sectors").select(F.col("name").alias("Company Name"), F.col("industry").alias("Industry"), F.col("symbol").alias("Symbol"), F.lit("").alias("ISIN Code"))
    found = raw.constituents(spark, {"A": _csv(rows.where("Symbol like '%1'")), "B": _csv(rows.where("Symbol like '%2'"))})
    return found.select("index_name", "symbol", "name", "industry")


@query("select date, category, round(buy, 2) as buy, round(net, 2) as net from nflows where date >= date '1998-01-01'")
def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Inputs(spark, sf_dir)("flows").where("date >= date'1998-01-01'")
    rows = rows.select("category", F.date_format("date", "dd-MMM-yyyy").alias("date"), F.col("buy").alias("buyValue"), F.col("sell").alias("sellValue"), F.col("net").alias("netValue"))
    return screens.normal_flows(raw.flows(spark, _json(rows.coalesce(1)))).select("date", "category", _r("buy", 2), _r("net", 2))


@query("select cast(event_id as varchar) as uuid, concat('S', lpad(cast(user_id % 120 as varchar), 4, '0')) as symbol from events where event_id % 10 = 0 and user_id % 120 < 60")
def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Inputs(spark, sf_dir).table("events").where("event_id % 10 = 0")
    symbol = lambda end: F.concat(F.lit("S"), F.lpad((F.col("user_id") % 120).cast("string"), 4, "0"), F.lit(end))
    rows = events.select(F.col("event_id").cast("string").alias("uuid"), F.array(F.struct(symbol(".NS").alias("symbol"), F.lit(0.5).alias("sentiment_score"))).alias("entities"))
    wanted = spark.range(60).select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("symbol"))
    return news.entity_rows(raw.articles(spark, _json(rows.coalesce(1))), wanted).select("uuid", "symbol")



@query("select symbol, date, round(close, 4) as close, volume, trades from bars where date >= date '1995-06-01' and symbol not like '%4'")
def archived_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip a session, in both layouts, read back by the archive source, which opens none before the first date.

    Dates stand in for those of the two layouts by an offset.
    """
    from barloom.sources.archives import DailyArchives, local

    bars, days = Inputs(spark, sf_dir)("bars"), 9000
    folder = local(scratch(spark))

    def pack(part):
        import io
        import os
        import zipfile

        import pandas as pd

        date = part.file_date.iloc[0]
        names = raw.LAYOUTS["new" if str(date) >= raw.NEW_LAYOUT else "old"]
        part = part.assign(series=part.symbol.str[-1:].map(lambda x: "GB" if x == "4" else "EQ"), isin="X", prev_close=0)
        text = part.rename(columns=names)[list(names.values())].to_csv(index=False)
        os.makedirs(folder, exist_ok=True)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "none")
            archive.writestr("bars.csv", text)
        with open(os.path.join(folder, f"bars_{date}.zip"), "wb") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"rows": [len(part)]})

    # a session has a row a symbol
    bars.withColumn("file_date", F.date_add("date", days)).groupBy("file_date").applyInPandas(pack, "rows long").agg(F.sum("rows")).first()
    spark.dataSource.register(DailyArchives)
    rows = spark.read.format("daily_archives").option("since", "2020-01-22").load(folder)
    found = raw.daily_bars(rows.select("path", "row", "date"), F.col("date")).withColumn("date", F.date_sub("date", days))
    return found.select("symbol", "date", _r("close"), "volume", "trades")


# --- served tables ----------------------------------------------------------------------------


def _night(given: Inputs, served: serving.Served, until: str | None = None) -> serving.Served:
    """A publication of the session before a date, or of the last one."""
    bars, indices = given("bars"), given("index_bars")
    if until:
        bars, indices = bars.where(F.col("date") < until), indices.where(F.col("date") < until)
    shot = snapshot(bars, given.actions(), given("sectors"), indices)
    day = bars.agg(F.max("date")).scalar()
    serving.publish_session(
        served, shot.stocks, shot.sectors.withColumn("date", day), shot.history.drop("sess"), shot.candles, indices, given("log") if not until else given("log").limit(0)
    )
    return served


@query(
    "select 'stock' as what, sym as name, date, round(price, 4) as value from flagged where sym = 'S0003' "
    "union all select 'sector', sector, (select max(date) from adj), score from scores "
    "union all select 'index', index_name, date, round(close, 4) from (select * from index_bars where index_name = 'ALL' order by date desc limit 5) "
    "union all select 'breadth', 'advances', date, advances from history where date >= date '2001-06-01' "
    "union all select 'candles', symbol, max(date), count(*) from adj where symbol = 'S0003' and date in (select date from axis) group by 2 "
    "union all select 'log', 'click', max(date), least(25, count(*)) from log where job = 'click' and status = 'ok'"
)
def asked_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with parameters after two publications, and one that broke off before its last step."""
    given = Inputs(spark, sf_dir)
    served = serving.Served(spark, scratch(spark))
    last = given("bars").agg(F.max("date")).first()[0]
    _night(given, served, str(last))
    served.write({"index_bars": given("index_bars").limit(0), "stock_metrics": served.table("stock_metrics").limit(0)})
    _night(given, served)
    served.clean()
    ask = lambda read, /, **params: served.ask(serving.READS[read], **params)
    value = lambda x: _rounded(F.col(x)).alias("value")
    row = lambda what, df, name, date, v: df.select(F.lit(what).alias("what"), name.alias("name"), F.col(date).alias("date"), v)
    candles_of = ask("candles", symbol="S0003")
    parts = [
        row("stock", ask("stock", symbol="S0003"), F.col("sym"), "date", value("price")),
        row("stock", ask("stock", symbol="S0003' or '1' = '1"), F.col("sym"), "date", value("price")),
        row("sector", ask("sectors_of", date=str(last)), F.col("sector"), "date", value("score")),
        row("index", ask("index_tail", name="ALL", rows=5), F.col("index_name"), "date", value("close")),
        row("breadth", ask("breadth_since", date="2001-06-01"), F.lit("advances"), "date", value("advances")),
        row("log", ask("log_of", job="click", status="ok", rows=25).agg(F.count("*").alias("n"), F.max("date").alias("date")), F.lit("click"), "date", value("n")),
        row("candles", candles_of.select("symbol", F.element_at("d", -1).cast("date").alias("date"), F.size("c").alias("n")), F.col("symbol"), "date", value("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CTES["spelt"] = """select concat(case s_suppkey % 5 when 0 then 'eclair' when 1 then 'Eclair' when 2 then 'éclair' when 3 then 'Zebra' else 'apple' end, ' ', lpad(cast(s_suppkey // 5 as varchar), 5, '0')) as sym from supplier"""


@query(
    "select sym, cast(row_number() over (order by strip_accents(lower(sym)), lower(sym), ascii(sym) desc) as bigint) as place from spelt"
)
def sorted_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case and accents, in the order of the Unicode collation."""
    key = F.col("s_suppkey")
    word = F.element_at(F.array(*map(F.lit, ("eclair", "Eclair", "éclair", "Zebra", "apple"))), (key % 5).cast("int") + 1)
    rows = Inputs(spark, sf_dir).table("supplier").select(F.concat(word, F.lit(" "), F.lpad(F.floor(key / 5).cast("string"), 5, "0")).alias("sym"))
    path = scratch(spark)
    screens.sort_table(rows, "stocks", "sym", collation="UNICODE").coalesce(1).write.parquet(path)  # one sorted file: a few thousand names
    placed = spark.read.parquet(path).withColumn("_at", F.monotonically_increasing_id())
    return placed.select("sym", (F.rank().over(W.orderBy("_at"))).cast("long").alias("place"))


# --- what the lake holds, and the nightly run ---------------------------------------------------


def _held_lake(given: Inputs) -> tuple[str, DataFrame]:
    """The bars as a yearly table, and holdings that were made before its last year and carried into it."""
    root = scratch(given.spark)
    store.write_years(given("bars"), f"{root}/daily")
    bars = given.spark.read.parquet(f"{root}/daily")
    last = bars.agg(F.max("year")).first()[0]
    carried.yearly_holdings(bars.where(F.col("year") < last)).write.parquet(f"{root}/before")
    carried.carried_holdings(given.spark.read.parquet(f"{root}/before"), bars, last).write.parquet(f"{root}/held")
    return f"{root}/daily", given.spark.read.parquet(f"{root}/held")


@query("select count(*) as bars, count(distinct symbol) as symbols, count(distinct date) as sessions, min(date) as first_date, max(date) as last_date from bars")
def lake_summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary from footers and carried bits: no column of the bars is read for it."""
    daily, held = _held_lake(Inputs(spark, sf_dir))
    counts = carried.footer_counts(spark, daily).first()  # one row, of a session of its own
    summary = carried.held_summary(held)
    return summary.select(F.lit(counts["bars"]).alias("bars"), "symbols", "sessions", F.lit(counts["first_date"]).alias("first_date"), F.lit(counts["last_date"]).alias("last_date"))


@query("select symbol, count(distinct date) as sessions from bars group by 1")
def symbol_coverage_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried.held_coverage(_held_lake(Inputs(spark, sf_dir))[1])


@query(
    "select 'price' as what, sym as name, sector, round(price, 4) as value from flagged "
    "union all select 'delivery', sym, sector, cast(volume::bigint % 100 as double) from "
    "(select f.sym, f.sector, b.volume from flagged f join bars b on b.symbol = f.sym and b.date = f.date) "
    "union all select 'below', sym, sector, round(dist_ath, 4) from flagged "
    "union all select 'score', sector, sector, cast(score as double) from scores "
    "union all select 'breadth', cast(date as varchar), '', cast(advances as double) from history "
    "union all select 'stored', 'bars', '', cast(count(*) as double) from bars where close > 0 "
    "union all select 'stored', 'actions', '', cast(count(*) as double) from actions "
    "union all select 'log', 'publish', 'ok', 2.0 union all select 'log', 'reference', 'failed', 1.0"
)
def nightly_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last session comes in as vendor files: the run publishes it, then runs again, once without a list that can be read."""
    given, root = Inputs(spark, sf_dir), scratch(spark)
    bars = given("bars").where("close > 0")
    last = bars.agg(F.max("date")).first()[0]
    before, session = F.col("date") < F.lit(last), bars.where(F.col("date") == F.lit(last))
    full = bars.select(
        "symbol", "date", F.lit("EQ").alias("series"), F.lit(None).cast("string").alias("isin"), "open", "high", "low", "close",
        F.lit(None).cast("double").alias("prev_close"), "volume", "traded_value", "trades",
    )
    store.write_years(full.where(before), f"{root}/daily")
    store.write_years(given("index_bars").where(before), f"{root}/index_daily", key="index_name")

    def filings(which: str) -> str:
        return _json(given("filings").where(which).select("symbol", "subject", F.date_format("ex", "dd-MMM-yyyy").alias("exDate")))

    nightly.refresh_actions(spark, root, filings("g < 2"))
    names = {"open": "Open Index Value", "high": "High Index Value", "low": "Low Index Value", "close": "Closing Index Value"}
    values = {**{c: F.col(c) for c in ("symbol", "open", "high", "low", "close", "volume", "traded_value", "trades")}, "series": F.lit("EQ"), "isin": F.lit(""), "prev_close": F.lit("")}
    record = F.concat_ws(",", F.lit("20"), F.lit("1"), "symbol", F.lit("EQ"), "volume", "volume", F.col("volume") % 100)
    delivery = scratch(spark)
    session.select(record.alias("value")).write.text(delivery)
    files = nightly.Files(
        _csv(session.select(*[values[k].cast("string").alias(v.upper()) for k, v in raw.LAYOUTS["old"].items()])),
        _csv(given("index_bars").where(F.col("date") == F.lit(last)).select(F.initcap("index_name").alias("Index Name"), *[F.col(k).cast("string").alias(v) for k, v in names.items()])),
        {"all": _csv(given("sectors").select(F.col("name").alias("Company Name"), F.col("industry").alias("Industry"), F.col("symbol").alias("Symbol"), F.lit("").alias("ISIN Code")))},
        filings("g = 2"), delivery,
    )
    nightly.run(spark, root, str(last), files, ("ALL",))
    files.lists = {"all": f"{root}/none.csv"}
    nightly.run(spark, root, str(last), files, ("ALL",))
    served = serving.Served(spark, f"{root}/published")
    stocks, log = served.table("stock_metrics"), served.table("ingest_log")
    row = lambda df, what, name, sector, value: df.select(
        F.lit(what).alias("what"), name.cast("string").alias("name"), sector.alias("sector"), value.cast("double").alias("value")
    )
    count = lambda path: spark.read.parquet(f"{root}/{path}").agg(F.count("*").alias("n"))
    noted = log.where("job = 'publish' or status = 'failed'").groupBy("job", "status").agg(F.count("*").alias("n"))
    nothing = F.lit("")
    parts = [
        row(stocks, "price", F.col("sym"), F.col("sector"), _rounded(F.col("price"))),
        row(stocks.where("delivery_pct is not null"), "delivery", F.col("sym"), F.col("sector"), F.col("delivery_pct")),
        row(stocks, "below", F.col("sym"), F.col("sector"), _rounded(F.col("dist_ath"))),
        row(served.table("sector_scores"), "score", F.col("sector"), F.col("sector"), F.col("score")),
        row(served.table("breadth_daily"), "breadth", F.col("date"), nothing, F.col("advances")),
        row(count("daily"), "stored", F.lit("bars"), nothing, F.col("n")),
        row(count("corporate_actions"), "stored", F.lit("actions"), nothing, F.col("n")),
        row(noted, "log", F.col("job"), F.col("status"), F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
