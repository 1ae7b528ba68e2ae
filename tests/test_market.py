"""Operators on hand-made inputs: labels, gaps in the grid, stored tables, raw files."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.functions import categories as cat
from barloom.functions import labels, numbers
from barloom.operators import actions, adjust, breadth, candles, carried, indicators, news, screens, serving, sessions, store
from barloom.sources import curated, raw

DAY = dt.date(2024, 1, 1)
GOLDEN = [
    ("Bonus 1:1", 2.0, "bonus"), ("Bonus 1 : 2", 1.5, "bonus"), ("Bonus 10:1", 11.0, "bonus"), ("Bonus 1 : 1250", None, "other"),
    ("Bonus 1:50", 1.02, "bonus"), ("Bonus 20:1", None, "other"), ("Bonus Debentures 1:1", None, "other"),
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share", 5.0, "split"), ("Face Value Split Rs 10 To Rs 1", 10.0, "split"),
    ("Face Value Split From Rs.5/- To Re.1/-", 5.0, "split"), ("Split From Rs 10/- Per Equity Share To Rs 2/-", 5.0, "split"),
    ("Sub-Division From Rs.10/- Each To Re.1/-", 10.0, "split"), ("Stock Split From Rs 10 Per Unit To Re 1", 10.0, "split"),
    ("Sub Division From Rs 10 (Ten) To Rs 2", 5.0, "split"), ("Split Of Shares Rs 2.50 Fully Paid To Re 0.50", 5.0, "split"),
    ("Split From Rs 2 To Rs 10", None, "other"), ("Split From Rs 100 To Rs 2", None, "other"), ("Bonus 1:1 / Face Value Split From Rs 10 To Rs 2", 10.0, "bonus+split"),
    ("Bonus 4:1 / Face Value Split From Rs 10 To Rs 1", None, "other"), ("Dividend - Rs 5 Per Share", None, "other"), ("Consolidation From Rs 1 To Rs 10", None, "other"),
]


def day(n):
    return DAY + dt.timedelta(days=n)


def bars_of(spark, closes):
    """{symbol: {day: close}} as bars."""
    rows = [(s, day(d), c, c * 1.1, c * 0.9, c, 100 + d, c * 100, 1) for s, by in closes.items() for d, c in by.items()]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long, traded_value double, trades long")


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string", dt.datetime: "timestamp", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_factor_labels(spark):
    rows = spark.createDataFrame([(s,) for s, _, _ in GOLDEN], "subject string")
    found = {r[0]: (r[1], r[2]) for r in labels.with_factor(rows, F.col("subject")).collect()}
    for subject, want, name in GOLDEN:
        assert found[subject][1] == name, subject
        assert found[subject][0] == (pytest.approx(want) if want else None), subject


@pytest.mark.parametrize(("text", "want"), [("5-Jan-2024", dt.date(2024, 1, 5)), ("05-January-2024", dt.date(2024, 1, 5)), ("2024-01-05", dt.date(2024, 1, 5)), ("never", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, labels.parse_date(F.col("t")), t=text) == want


def test_numbers(spark):
    assert one(spark, numbers.num(F.col("t")), t=" 1.5 ") == 1.5
    assert one(spark, numbers.num(F.col("t")), t="1,234") == 0.0
    assert one(spark, numbers.num_commas(F.col("t")), t="1,234.5") == 1234.5
    assert one(spark, numbers.num(F.col("t")), t=None) == 0.0
    assert one(spark, numbers.num(F.col("t")), t="NaN") == 0.0
    assert one(spark, numbers.whole(F.col("t")), t="-2.9") == -2
    assert [one(spark, numbers.round_even(F.col("x")), x=x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, numbers.percent_of(F.col("a"), F.col("b")), a=1, b=0) == 0


def test_categories(spark):
    assert [one(spark, cat.drawdown_bucket(F.col("x")), x=x) for x in (2.9, 3.0, 19.9, 39.0, 40.0)] == ["high", "dip", "corr", "bear", "deep"]
    assert one(spark, cat.price_text(F.col("x")), x=1234567.891) == "12,34,567.89"
    assert one(spark, cat.price_text(F.col("x")), x=-999.5) == "-999.50"
    assert one(spark, cat.amount_text(F.col("x")), x=2.5e7) == "₹2.50 Cr"
    assert [one(spark, cat.amount_text(F.col("x")), x=x) for x in (3e7, 123456.0, 99999.5, -2e7, 1000.0)] == ["₹3 Cr", "₹1.23 L", "₹99,999.5", "₹-2,00,00,000", "₹1,000"]
    assert [one(spark, cat.percent_text(F.col("x")), x=x) for x in (1.25, -0.5, 0.0)] in (["+1.3%", "-0.5%", "+0.0%"], ["+1.2%", "-0.5%", "+0.0%"])
    assert [one(spark, cat.bar_width(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((1, 8), (0, 0), (5, 5))] == [13, 0, 100]
    assert [one(spark, cat.meter(F.col("x"), F.lit(60.0)), x=x) for x in (30.0, 90.0, -1.0)] == [50.0, 100.0, 0.0]
    days = F.array(*[F.lit(dt.date(2026, 3, 12) + dt.timedelta(days=7 * i)) for i in range(5)])
    note = lambda n: one(spark, cat.window_note(days, F.col("n")), n=n)
    assert note(45) == "45 sessions · ~2 months · 12 Mar → 9 Apr" and note(2) == "2 sessions · ~1 week · 2 Apr → 9 Apr"
    assert one(spark, cat.clean_symbol(F.col("x")), x=" m&m-x ") == "M&M-X"
    assert one(spark, cat.clean_symbol(F.col("x")), x="a b") is None
    assert one(spark, cat.with_suffix(F.col("x")), x="ABC") == "ABC.NS" and one(spark, cat.without_suffix(F.col("x")), x="ABC.NS") == "ABC"
    assert one(spark, cat.pad_left(F.col("x"), 4), x=[1.0, 2.0]) == [0, 0, 1, 2]
    assert one(spark, cat.pad_left(F.col("x"), 2), x=[1.0, 2.0, 3.0]) == [2, 3]
    assert one(spark, cat.ticks(F.col("x")), x=[float(i) for i in range(11)]) == [0, 2, 4, 6, 8, 10]
    opens = [(4, 0, False), (3, 44, False), (3, 45, True), (10, 0, True), (10, 1, False)]
    for hour, minute, _ in opens[1:]:
        at = dt.datetime(2024, 1, 3, hour, minute)
        assert one(spark, cat.market_open(F.col("t")), t=at) == next(x for h, m, x in opens if (h, m) == (hour, minute))
    assert one(spark, cat.market_open(F.col("t")), t=dt.datetime(2024, 1, 6, 5, 0)) is False
    assert one(spark, cat.age_label(F.col("a"), F.col("b")), a=dt.datetime(2024, 1, 1), b=dt.datetime(2024, 1, 1, 5, 10)) == "5h ago"
    assert one(spark, cat.span_label(F.col("n")), n=21) == "~1 month" and one(spark, cat.span_label(F.col("n")), n=300) == "14 months"


def test_lags_count_sessions_not_rows(spark):
    closes = {"A": {d: 10.0 + d for d in range(10) if d != 4}, "B": {d: 20.0 for d in range(10)}}
    rows = {r["sess"]: r for r in indicators.with_grid(sessions.on_axis(bars_of(spark, closes))).where("symbol = 'A'").collect()}
    assert rows[3]["prev"] == 12.0 and rows[5]["prev"] is None  # no bar in session 4
    assert rows[9]["close5"] is None and rows[8]["close5"] == 13.0
    assert rows[9]["hi52"] == pytest.approx(19 * 1.1)
    counts = {r["sess"]: r["counted"] for r in breadth.breadth_counters(breadth.with_indicators(sessions.on_axis(bars_of(spark, closes)))).collect()}
    assert counts[3] == 2 and counts[5] == 1 and 0 not in counts


def test_average_carries_over_gaps(spark):
    values = [10.0, 12.0, 9.0, 15.0]
    rows = indicators.with_emas(sessions.on_axis(bars_of(spark, {"A": dict(zip((0, 1, 5, 6), values, strict=True)), "B": {d: 1.0 for d in range(8)}})))
    want, e = [], None
    for x in values:
        e = x if e is None else e + (x - e) * 2 / 11
        want.append(e)
    assert [r["e10"] for r in rows.where("symbol = 'A'").orderBy("sess").collect()] == pytest.approx(want)


def test_one_bar_a_day(spark):
    rows = spark.createDataFrame([("A", DAY, "BE", 5), ("A", DAY, "EQ", 9), ("B", DAY, "EQ", 1)], "symbol string, date date, series string, volume long")
    assert sorted((r["symbol"], r["series"]) for r in sessions.one_bar_a_day(rows).collect()) == [("A", "EQ"), ("B", "EQ")]


def test_actions_snap_verify_and_adjust(spark):
    closes = {"A": {0: 100.0, 1: 101.0, 2: 50.0, 3: 51.0}, "B": {0: 10.0, 1: 10.1}, "C": {0: 10.0}}
    bars = bars_of(spark, closes)
    filings = [("A", day(4), "Bonus 1:1"), ("A", day(2), "Dividend"), ("B", day(1), "Bonus 1:1"), ("C", day(0), "Bonus 1:1"), ("", day(0), "Bonus 1:1"), ("A", None, "Bonus 1:1")]
    found = actions.verify_actions(spark.createDataFrame(filings, "symbol string, ex date, subject string"), bars)
    by = {r["symbol"]: r for r in found.collect()}
    assert set(by) == {"A", "B", "C"}
    assert (by["A"]["status"], by["A"]["ex_date"], by["A"]["source_ex_date"]) == ("verified", day(2), day(4))
    assert by["B"]["status"] == "unverified" and by["C"]["status"] == "no_bars"
    adjusted = {(r["symbol"], r["date"]): r for r in adjust.adjusted_bars(bars, actions.dedup_actions(found)).collect()}
    assert adjusted["A", day(1)]["close"] == 50.5 and adjusted["A", day(1)]["volume"] == 202 and adjusted["A", day(2)]["k"] == 1.0
    assert adjusted["B", day(0)]["k"] == 1.0
    highs = {r["symbol"]: r for r in adjust.all_time_highs(adjust.adjusted_bars(bars, found)).collect()}
    assert highs["A"]["ath"] == pytest.approx(51 * 1.1) and highs["A"]["since"] == day(0)


def test_dedup_prefers_applied(spark):
    rows = [("A", DAY, False, DAY, "x"), ("A", DAY, True, day(1), "y"), ("A", day(9), False, DAY, "b"), ("A", day(9), False, DAY, "a")]
    found = actions.dedup_actions(spark.createDataFrame(rows, "symbol string, ex_date date, applied boolean, source_ex_date date, subject string"))
    assert sorted(r["subject"] for r in found.collect()) == ["a", "y"]


def test_candles_and_tails(spark):
    payload = candles.candle_payload(bars_of(spark, {"A": {d: d + 1.0 for d in range(8)}}), 5)
    row = payload.first()
    assert row["d"] == [str(day(d)) for d in range(3, 8)] and row["c"] == [4, 5, 6, 7, 8] and row["v"] == [103, 104, 105, 106, 107]
    assert [r["c"] for r in candles.candle_tail(payload, "A", 2).orderBy("i").collect()] == [7, 8]
    assert candles.candle_tail(payload, "Z").count() == 0


def test_stored_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, at int")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "id long, name string, at int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.upsert(old, new, ["id"])) == [(1, "a", 1), (2, "B", 9), (3, "C", 9)]
    assert rows(store.upsert_columns(old, new, ["id"], ["name"])) == [(1, "a", 1), (2, "B", 1), (3, "C", 9)]
    assert rows(store.insert_absent(old, new, ["id"])) == [(1, "a", 1), (2, "b", 1), (3, "C", 9)]
    assert rows(store.delete_keys(old, new.select("id"), ["id"])) == [(1, "a", 1)]
    assert rows(store.replace_session(old, new.withColumn("at", F.lit(1)), "at")) == [(2, "B", 1), (3, "C", 1)]
    path = f"{tmp_path}/table"
    store.publish(old, path)
    for _ in range(2):  # publishing twice is as publishing once, and may read what it replaces
        store.publish(store.upsert(spark.read.parquet(path), new, ["id"]), path)
    assert rows(spark.read.parquet(path)) == [(1, "a", 1), (2, "B", 9), (3, "C", 9)]
    store.append(old, path)
    assert spark.read.parquet(path).count() == 5
    back = store.from_payload(store.with_payload(old, ["id"]), "name string, at int")
    assert rows(back) == rows(old)


def test_yearly_files(spark, tmp_path):
    bars = bars_of(spark, {"A": {d: 1.0 + d for d in range(0, 800, 100)}})
    store.write_years(bars, f"{tmp_path}/lake")
    store.write_years(bars.where("year(date) = 2025").withColumn("close", F.lit(7.0)), f"{tmp_path}/lake")
    found = store.read_years(spark, f"{tmp_path}/lake", "2025-01-01")
    assert {r["close"] for r in found.collect()} == {7.0} and store.read_years(spark, f"{tmp_path}/lake").count() == 8
    # without force only the open year is written again
    store.write_years(bars.withColumn("close", F.lit(9.0)), f"{tmp_path}/lake", force=False)
    again = store.read_years(spark, f"{tmp_path}/lake").collect()
    assert {r["close"] for r in again if r["year"] == 2025} == {9.0} and 9.0 not in {r["close"] for r in again if r["year"] == 2024} and len(again) == 8
    assert curated.daily(spark, f"{tmp_path}/lake", "2025-01-01").count() == sum(r["year"] == 2025 for r in again)


def test_raw_files(spark, tmp_path):
    old = "SYMBOL , SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,ISIN\n ABC ,EQ,1,2,0.5,1.5,1,100,150,\n,,,,\nDEF,XX,1,2,3,4,5,6,7,\nGHI,BE,1,2,1,0,1,1,1,I\n"
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("cm.csv", old)
    (tmp_path / "a.zip").write_bytes(blob.getvalue())
    new = "TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\nXYZ,EQ,IN1,5,6,4,5.5,5,10,55,3\n"
    (tmp_path / "b.csv").write_text(new)
    a = raw.daily_bars(raw.csv_rows(spark, f"{tmp_path}/a.zip"), F.lit("2023-05-05").cast("date")).collect()
    assert [(r["symbol"], r["isin"], r["close"], r["volume"], r["trades"]) for r in a] == [("ABC", None, 1.5, 100, 0)]
    b = raw.daily_bars(raw.csv_rows(spark, f"{tmp_path}/b.csv"), F.lit("2024-05-05").cast("date")).collect()
    assert [(r["symbol"], r["isin"], r["close"], r["trades"]) for r in b] == [("XYZ", "IN1", 5.5, 3)]
    (tmp_path / "i.csv").write_text("Index Name,Open Index Value,High Index Value,Low Index Value,Closing Index Value\nNifty x ,1,2,1,2\nNone,-,-,-,-\n")
    assert [r["index_name"] for r in raw.index_bars(raw.csv_rows(spark, f"{tmp_path}/i.csv"), F.lit(None).cast("date")).collect()] == ["NIFTY X"]
    (tmp_path / "s.csv").write_text("SYMBOL, SERIES, CLOSE_PRICE, DELIV_PER\nABC, EQ, 5, 50\nABC, EQ, 6, -\nABC, GB, 7, 1\n")
    assert [(r["symbol"], r["close"], r["delivery_pct"]) for r in raw.security_report(raw.csv_rows(spark, f"{tmp_path}/s.csv")).collect()] == [("ABC", 6.0, 0.0)]
    (tmp_path / "d.dat").write_text("10,head\n20,1,ABC,EQ,10,5,50.5\n20,2,DEF,XX,1,1,1\n20,short\n")
    assert [tuple(r) for r in raw.deliveries(spark, f"{tmp_path}/d.dat").collect()] == [("ABC", 50.5)]
    (tmp_path / "f.json").write_text(json.dumps([{"symbol": " ABC ", "subject": "Bonus 1:1", "exDate": "05-Jan-2024", "more": 1}]))
    assert [tuple(r) for r in raw.filings(spark, f"{tmp_path}/f.json").collect()] == [("ABC", dt.date(2024, 1, 5), "Bonus 1:1")]
    (tmp_path / "c.csv").write_text("Company Name,Industry,Symbol,ISIN Code\nAbc Ltd,,ABC,X\nBad,Y,,Z\n")
    assert [tuple(r) for r in raw.constituents(spark, {"TOP": f"{tmp_path}/c.csv"}).collect()] == [("TOP", "ABC", "Abc Ltd", None, "X")]
    (tmp_path / "w.json").write_text(json.dumps([{"category": "FII/FPI *", "date": "05-Jan-2024", "buyValue": "1,000.5", "sellValue": "1", "netValue": "999.5"}]))
    assert [tuple(r) for r in screens.normal_flows(raw.flows(spark, f"{tmp_path}/w.json")).collect()] == [(dt.date(2024, 1, 5), "FII", 1000.5, 1.0, 999.5)]
    (tmp_path / "n.json").write_text(json.dumps([{"uuid": "u", "entities": [{"symbol": "A.NS", "sentiment_score": 0.1}, {"symbol": "A.NS", "sentiment_score": 0.4}]}]))
    assert [tuple(r) for r in news.entity_rows(raw.articles(spark, f"{tmp_path}/n.json")).collect()] == [("u", "A", 0.4)]


def test_watchlist_import(spark):
    asked = spark.createDataFrame([(0, " abc"), (1, "bad one"), (2, "ABC"), (3, "held"), (4, "new")], "pos int, symbol string")
    held = spark.createDataFrame([("HELD",)], "symbol string")
    assert [r["symbol"] for r in screens.import_symbols(asked, held).orderBy("pos").collect()] == ["ABC", "NEW"]
    assert [r["symbol"] for r in screens.import_symbols(asked, held, cap=3).collect()] == ["ABC"]


@pytest.mark.parametrize("most", [None, 60])
def test_averages_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(indicators, "BLOCK", 7 if most is None else 2000)
    values = [100 + (i * 37 % 23) for i in range(60)]
    rows = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(values)] + [("B", 0, 5.0)], "symbol string, sess int, close double")
    periods = (2, 10) if most is None else (2, 10, 200)  # short blocks carry long averages over hundreds of them
    found = indicators.with_emas(rows, periods, most_rows=most).where("symbol = 'A'").orderBy("sess").collect()
    for p in periods:
        want, e = [], None
        for x in values:
            e = x if e is None else e + (x - e) * 2 / (p + 1)
            want.append(e)
        assert [r[f"e{p}"] for r in found] == pytest.approx(want, rel=1e-9)
    assert set(found[0].asDict()) == {"symbol", "sess", "close", *[f"e{p}" for p in periods]}


def test_broken_off_publication(spark, tmp_path):
    old, path = spark.createDataFrame([(1,)], "id long"), f"{tmp_path}/table"
    store.publish(old, path)
    (tmp_path / "table").rename(tmp_path / "table.old")  # as after the first of the two renames
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "table").rename(tmp_path / "table.old")
    store.publish(spark.createDataFrame([(2,), (3,)], "id long"), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "table.old").exists()


def test_window_filter_reaches_the_scan(spark, tmp_path):
    bars = bars_of(spark, {"A": {d: 1.0 + d for d in range(0, 800, 10)}})
    store.write_years(bars, f"{tmp_path}/lake")
    rows = sessions.last_sessions(store.read_years(spark, f"{tmp_path}/lake"), 5)
    assert rows.count() == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("Scan parquet") if "PartitionFilters" in x]
    assert "NestedLoop" not in plan and any("year" in x.split("PartitionFilters: [")[1].split("]")[0] and "subquery" in x for x in scans)


def test_adjustment_has_no_arrays_and_no_wide_frames(spark):
    bars = bars_of(spark, {"A": {0: 10.0, 1: 10.0, 2: 5.0}, "B": {0: 3.0}})
    acts = [("A", day(1), 2.0, True), ("A", day(2), 1.5, True), ("A", day(9), 4.0, True), ("A", day(2), 3.0, False), ("C", day(1), 2.0, True), ("B", day(1), 100.0, True)]
    rows = adjust.adjusted_bars(bars, spark.createDataFrame(acts, "symbol string, ex_date date, factor double, applied boolean"))
    assert {(r.symbol, r.date): r.k for r in rows.collect()} == {("A", day(0)): 12.0, ("A", day(1)): 6.0, ("A", day(2)): 4.0, ("B", day(0)): 1.0}
    plan = indicators.with_grid(sessions.on_axis(rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("lambda", "collect_list", "RangeFrame, -"))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 252])
def test_extremes_by_blocks(spark, width):
    import random

    rng = random.Random(width)
    held = {s: sorted(rng.sample(range(40), rng.randint(1, 30))) for s in "ABCDE"}
    rows = [(s, d, float(rng.randint(1, 50)), float(rng.randint(1, 50))) for s, days in held.items() for d in days]
    df = spark.createDataFrame(rows, "symbol string, sess int, high double, low double")
    got = {(r.symbol, r.sess): (r.hi52, r.lo52) for r in indicators.with_extremes(indicators.with_fillers(df), width).where("_bar").collect()}
    for s, d, _, _ in rows:
        near = [r for r in rows if r[0] == s and d - width < r[1] <= d]
        assert got[s, d] == (max(r[2] for r in near), min(r[3] for r in near))


def test_no_interpreted_code(spark):
    """The plans around filings compile: each pattern is in them once."""
    rows = spark.createDataFrame([("A", day(2), s) for s, _, _ in GOLDEN], "symbol string, ex date, subject string")
    bars = bars_of(spark, {"A": {0: 10.0, 1: 10.0, 2: 5.0}})
    held = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        found = actions.verify_actions(rows, bars)
        assert found.count() == sum(1 for _, f, _ in GOLDEN if f)
        assert actions.dedup_actions(found).count() == 2  # of factors near 1 and near 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    plan = actions.verify_actions(rows, bars)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 4 and plan.count("RLIKE(") == 2


def test_carried_state_reads_what_it_must(spark, tmp_path):
    closes = {"A": {d: 10.0 + d for d in range(0, 900, 9)}, "B": {d: 50.0 for d in range(0, 850, 9)}, "N": {891: 7.0}}
    store.write_years(bars_of(spark, closes), f"{tmp_path}/lake")
    bars = store.read_years(spark, f"{tmp_path}/lake")
    acts = spark.createDataFrame([("A", day(891), 2.0, True), ("B", day(100), 5.0, True)], "symbol string, ex_date date, factor double, applied boolean")
    known = acts.where("symbol = 'A'")  # that of B comes late
    last = day(891)
    state = carried.averages_state(bars.where(F.col("date") < last), known.limit(0))
    now = carried.carried_averages(state, bars.where(F.col("date") == last), bars, acts)
    got = {r.symbol: r for r in carried.current_averages(now, acts).collect()}
    want = {r.symbol: r for r in carried.current_averages(carried.averages_state(bars, acts), acts).collect()}
    assert set(got) == {"A", "B", "N"}
    for s in got:
        assert got[s].date == want[s].date and [got[s][f"e{p}"] for p in indicators.PERIODS] == pytest.approx([want[s][f"e{p}"] for p in indicators.PERIODS])
    year = last.year
    highs = carried.yearly_highs(bars.where(F.col("year") < year), known.limit(0))
    found = {r.symbol: tuple(r) for r in carried.merged_highs(carried.carried_highs(highs, bars, acts, year)).collect()}
    assert found == {r.symbol: tuple(r) for r in adjust.all_time_highs(adjust.adjusted_bars(bars, acts)).collect()}
    plan = carried.yearly_highs(bars.where(F.col("year") >= year), acts)._jdf.queryExecution().executedPlan().toString()
    assert "(year#" in plan and f">= {year})" in plan.split("PartitionFilters")[1][:120]


def test_publication_breaks_off_anywhere(spark, tmp_path, monkeypatch):
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    served = serving.Served(spark, f"{tmp_path}/served")
    state = lambda: {t: served.table(t).first().n for t in served.names()}
    assert state() == {} and served.pointer()["version"] == 0
    assert served.publish({"a": one(1), "b": one(1)}) == 1
    calls = {"n": 0}

    def broken(at):
        def step(real):
            def run(*args, **kwargs):
                calls["n"] += 1
                if calls["n"] > at:
                    raise OSError("lost")
                return real(*args, **kwargs)
            return run
        return step

    for at in range(4):  # before the first table, after it, before the pointer is written, before it is renamed
        calls["n"] = 0
        with monkeypatch.context() as m:
            m.setattr(serving.Served, "point", broken(2)(serving.Served.point) if at == 2 else serving.Served.point)
            m.setattr(serving.Served, "_files", broken(1)(serving.Served._files) if at == 3 else serving.Served._files)
            rows = {"a": one(2), "b": one(2) if at > 1 else one(2).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))}
            if at == 0:
                rows = {"b": rows["b"], "a": rows["a"]}
            if at == 2:
                calls["n"] = 9
            with pytest.raises(Exception, match="lost"):
                served.publish(rows)
        assert state() == {"a": 1, "b": 1}
    version = served.pointer()["version"]
    held = served.table("a")
    assert served.publish({"a": served.table("a").unionByName(one(5)), "c": one(3)}) == version + 1
    assert state()["b"] == 1 and state()["c"] == 3 and held.count() == 1  # a reader of the version before goes on
    with pytest.raises(RuntimeError, match="published after"):
        served.point(served.write({"a": one(9)}), version)
    served.clean()
    assert served.table("a").count() == 2 and held.count() == 1 and len(list((tmp_path / "served/tables/a").iterdir())) == 2
    assert served.ask("select n from {a} where cast(n as string) = :x", x="1' or '1' = '1").count() == 0


def test_archives_are_pruned_unopened(spark, tmp_path):
    import zipfile

    from barloom.sources.archives import DailyArchives, date_in

    assert date_in("cm05JAN2024bhav.csv.zip") == dt.date(2024, 1, 5) == date_in("x_20240105.zip") and date_in("none.zip") is None
    for d in (1, 2, 3):
        with zipfile.ZipFile(tmp_path / f"bars_2024-01-0{d}.zip", "w") as archive:
            archive.writestr("a.csv", f"Symbol, Close \nA,{d}\n\nB,{d}\n")
            archive.writestr("b.CSV", "\ufeffSymbol,Close\nC,\n")
    (tmp_path / "bars_2024-01-09.zip").write_bytes(b"broken")
    spark.dataSource.register(DailyArchives)
    rows = spark.read.format("daily_archives").option("until", "2024-01-03").load(f"file:{tmp_path}")
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r.date.day, r.row["symbol"], r.row["close"]) for r in rows.collect())
    assert got == sorted([(d, s, str(d)) for d in (1, 2, 3) for s in "AB"] + [(d, "C", "") for d in (1, 2, 3)])
    assert spark.read.format("daily_archives").option("since", "2025-01-01").load(str(tmp_path)).count() == 0
    held = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        pushed = spark.read.format("daily_archives").option("push", "true").load(str(tmp_path)).where("date >= date'2024-01-02' and date < date'2024-01-04' and row['symbol'] = 'A'")
        assert sorted(r.date.day for r in pushed.collect()) == [2, 3]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", held)


def test_locale_order(spark):
    rows = spark.createDataFrame([(s,) for s in ("b", "B", "a", "á", "A", "z", "Á")], "sym string")
    names = lambda **k: [r.sym for r in screens.sort_table(rows, "stocks", "sym", **k).collect()]
    assert names(collation="UNICODE") == ["a", "A", "á", "Á", "b", "B", "z"] and names() == ["A", "B", "a", "b", "z", "Á", "á"]
    assert names(direction="desc", collation="UNICODE")[0] == "z"


def test_sorts_and_first_clicks(spark):
    rows = spark.createDataFrame([("B", "x", 2.0, 3), ("A", "y", 1.0, 1), ("C", "x", 2.0, 2)], "sym string, sector string, price double, tag_rank int")
    names = lambda df: [r["sym"] for r in df.collect()]
    assert names(screens.sort_table(rows, "stocks", "sym")) == ["A", "B", "C"] and names(screens.sort_table(rows, "stocks", "price")) == ["B", "C", "A"]
    assert names(screens.sort_table(rows, "stocks", "price", "asc")) == ["A", "B", "C"] and names(screens.sort_table(rows, "stocks", "tag")) == ["B", "C", "A"]
    assert screens.first_direction(rows, "members", "sym") == "asc" and names(screens.sort_table(rows, "stocks", "none")) == ["B", "A", "C"]


def test_command_line(spark, tmp_path, capsys):
    from barloom import __main__ as command

    root = f"{tmp_path}/lake"
    head = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,ISIN\n"
    for d in range(3):
        (tmp_path / f"{d}.csv").write_text(head + f"ABC,EQ,10,{12 + d},9,{10 + d},10,100,1000,X\n")
    files = [raw.daily_bars(raw.csv_rows(spark, f"{tmp_path}/{d}.csv"), F.lit(f"2023-12-{28 + d}").cast("date")) for d in range(2)]
    store.write_years(files[0].unionByName(files[1]), f"{root}/daily")
    spark.createDataFrame([("NIFTY 50", day(0), 1.0, 1.0, 1.0, 1.0)], "index_name string, date date, open double, high double, low double, close double").withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{root}/index_daily")
    (tmp_path / "f.json").write_text(json.dumps([{"symbol": "ABC", "subject": "Bonus 1:1", "exDate": "05-Jan-2020"}]))
    (tmp_path / "c.csv").write_text("Company Name,Industry,Symbol,ISIN Code\nAbc Ltd,Steel,ABC,X\n")
    command.main(["reference", root, "--list", f"TOP={tmp_path}/c.csv"])
    command.main(["actions", root, "--files", f"{tmp_path}/f.json"])
    (tmp_path / "i.csv").write_text("Index Name,Open Index Value,High Index Value,Low Index Value,Closing Index Value\nNifty 50,1,2,1,2\n")
    (tmp_path / "d.dat").write_text("20,1,ABC,EQ,100,60,60.5\n")
    night = ["eod", root, "--files", f"{tmp_path}/2.csv", "--date", "2023-12-30", "--indices", f"{tmp_path}/i.csv", "--delivery", f"{tmp_path}/d.dat"]
    command.main([*night, "--list", f"TOP={tmp_path}/c.csv", "--filings", f"{tmp_path}/gone.json"])
    capsys.readouterr()
    command.main(["summary", root])
    assert "|3   |1      |3       |2023-12-28|2023-12-30|" in capsys.readouterr().out  # sessions of the year stay
    served = serving.Served(spark, f"{root}/published")
    ask = lambda read, **p: [tuple(r) for r in served.ask(serving.READS[read], **p).collect()]
    first = served.ask(serving.READS["stock"], symbol="ABC").first()
    assert (first["sector"], first["price"], first["delivery_pct"]) == ("Steel", 12.0, 60.5)
    assert ask("meta", key="last_ingested_session") == [("2023-12-30",)]
    log = served.table("ingest_log").select("job", "status").collect()
    assert {tuple(r) for r in log} == {("reference", "ok"), ("backfill", "ok"), ("indices", "ok"), ("actions", "failed"), ("publish", "ok")}
    command.main(night)  # the same night again
    assert served.pointer()["version"] == 2 and spark.read.parquet(f"{root}/daily").count() == 3
    assert [served.table(t).count() for t in ("stock_metrics", "index_bars", "stock_candles", "breadth_daily")] == [1, 2, 1, 3]
    (tmp_path / "g.json").write_text(json.dumps([{"symbol": "ABC", "subject": "Bonus 1:2", "exDate": "05-Feb-2020"}]))
    command.main(["actions", root, "--files", f"{tmp_path}/g.json"])
    assert spark.read.parquet(f"{root}/corporate_actions").count() == 2  # earlier filings stay
    command.main(["indices", root, "--files", f"{tmp_path}/i.csv", "--date", "2023-12-29"])
    assert spark.read.parquet(f"{root}/index_daily").where("year = 2023").count() == 2


def test_holdings_from_footers_and_bits(spark, tmp_path):
    rows = [("A", dt.date(2022, 12, 30), 1.0), ("B", dt.date(2022, 12, 30), 1.0), ("A", dt.date(2023, 1, 2), 1.0), ("A", dt.date(1969, 12, 31), 1.0), ("A", dt.date(2023, 1, 2), 2.0)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    store.write_years(bars, f"{tmp_path}/daily")
    stored = spark.read.parquet(f"{tmp_path}/daily")
    found = carried.footer_counts(spark, f"{tmp_path}/daily")
    plan = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date)]" in plan
    assert tuple(found.first()) == (5, dt.date(1969, 12, 31), dt.date(2023, 1, 2))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    held = carried.carried_holdings(carried.yearly_holdings(stored.where("year < 2023")), stored, 2023)
    assert tuple(carried.held_summary(held).first()) == (2, 3)
    assert {tuple(r) for r in carried.held_coverage(held).collect()} == {("A", 3), ("B", 1)}
    files = carried.carried_holdings(spark.createDataFrame([], held.schema), stored, 2023)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in files and ">= 2023)" in files
    assert tuple(carried.held_summary(held.limit(0)).first()) == (0, 0)


def test_sessions_added_to_a_growing_year(spark, tmp_path):
    row = lambda s, d, c: (s, dt.date(2023, 5, d), c)
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, date date, close double")
    root = f"{tmp_path}/lake"
    store.add_sessions(frame([row("A", 2, 1.0), row("B", 2, 2.0)]), root)
    store.add_sessions(frame([("A", dt.date(2022, 5, 2), 9.0)]), root)
    for _ in range(2):
        store.add_sessions(frame([row("A", 3, 1.5), row("A", 2, 7.0)]), root)  # B is gone from the second of May
    found = spark.read.parquet(root).select("symbol", "date", "close").collect()
    assert {tuple(r) for r in found} == {row("A", 2, 7.0), row("A", 3, 1.5), ("A", dt.date(2022, 5, 2), 9.0)} and len(found) == 3
    store.add_sessions(frame([]), root)
    assert spark.read.parquet(root).count() == 3
