"""Screens and rollups over the latest metrics, flows and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.categories import BUCKETS, clean_symbol, drawdown_bucket, stock_tag
from barloom.functions.numbers import num_commas, round_up_half

HIGH_MODES = {"ath": "is_ath", "w52": "is52", "wk": "wk_break"}


def with_tags(metrics: DataFrame) -> DataFrame:
    tag, rank = stock_tag(F.col("is_ath"), F.col("is52"), F.col("wk_break"), F.col("dist_ath"))
    return metrics.withColumns({"tag": tag, "tag_rank": rank})


def highs_screen(metrics: DataFrame, mode: str, sector: str | None = None) -> DataFrame:
    """Stocks at highs: ``ath``, ``w52`` or ``wk``, of one sector if given."""
    pool = metrics.where(F.col(HIGH_MODES[mode]))
    return pool.where(F.col("sector") == sector) if sector else pool


def pool_sizes(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.count_if(flag).alias(mode) for mode, flag in HIGH_MODES.items()])


def pool_sectors(pool: DataFrame) -> DataFrame:
    return pool.groupBy("sector").agg(F.count("*").alias("stocks"))


def drawdown_view(metrics: DataFrame, sector: str | None = None, bucket: str | None = None) -> DataFrame:
    rows = metrics.withColumn("bucket", drawdown_bucket(F.col("dist_ath")))
    rows = rows.where(F.col("sector") == sector) if sector else rows
    return rows.where(F.col("bucket") == bucket) if bucket else rows


def drawdown_buckets(metrics: DataFrame) -> DataFrame:
    """Rows (bucket, stocks, pct) for every bucket, empty ones included."""
    counts = drawdown_view(metrics).groupBy("bucket").agg(F.count("*").alias("stocks"))
    names = metrics.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    rows = F.broadcast(names).join(counts, "bucket", "left").na.fill(0, ["stocks"])
    total = counts.agg(F.sum("stocks").alias("total"))
    pct = round_up_half(F.col("stocks") * 100.0 / F.greatest(F.lit(1), F.coalesce("total", F.lit(0))))
    return rows.crossJoin(F.broadcast(total)).select("bucket", "stocks", pct.alias("pct"))  # one row


def drawdown_by_sector(metrics: DataFrame) -> DataFrame:
    by = metrics.groupBy("sector").agg(F.avg("dist_ath").alias("mean"), F.count("*").alias("stocks"))
    return by.orderBy("mean", "sector")


def watchlist_stats(metrics: DataFrame, watch: DataFrame, max_positions: int = 6) -> DataFrame:
    """One row about the watched stocks; ``watch`` holds symbols as ``sym``."""
    rows = metrics.join(watch, "sym", "left_semi")
    return rows.agg(
        F.count("*").alias("stocks"),
        F.avg("chg1w").alias("chg1w"),
        F.avg("dist_ath").alias("dist_ath"),
        F.count_if(F.col("is_ath") | F.col("is52")).alias("at_highs"),
        (F.lit(max_positions) - F.count("*")).alias("slots"),
    )


def import_symbols(raw: DataFrame, held: DataFrame, cap: int = 200) -> DataFrame:
    """The symbols to add to a watchlist: cleaned, distinct, in first-seen order, within the room left.

    ``raw`` has (pos, symbol), ``held`` (symbol).  Symbols already held take up room too.  A
    list is one user's input, capped at ``cap``.
    """
    clean = raw.withColumn("symbol", clean_symbol(F.col("symbol"))).where("symbol is not null")
    asked = clean.groupBy("symbol").agg(F.min("pos").alias("pos"))
    room = max(0, cap - held.count())
    return asked.orderBy("pos").limit(room).join(held, "symbol", "left_anti").select("symbol", "pos")


#: Sort keys of the tables, each with its expression and, where it is not the rule, the direction of a first click.
SORTS: dict[str, dict[str, tuple[str, str | None]]] = {
    "stocks": {
        "sym": ("sym", "asc"), "sector": ("sector", "asc"), "price": ("price", None), "chg1d": ("chg1d", None), "chg1w": ("chg1w", None),
        "dist_ath": ("dist_ath", "asc"), "tag": ("tag_rank", None),
    },
    "drawdowns": {
        "sym": ("sym", "asc"), "sector": ("sector", "asc"), "price": ("price", None), "chg1d": ("chg1d", None), "dist_ath": ("dist_ath", None), "status": ("dist_ath", None),
    },
    "sectors": {
        "name": ("sector", "asc"), "count": ("count", None), "adv": ("adv / greatest(1, count)", None), "dma_pct": ("dma_pct", None), "new_highs": ("new_highs", None),
        "wk": ("wk", None), "score": ("score", None),
    },
}
SORTS["members"] = {k: v for k, v in SORTS["stocks"].items() if k != "sector"}


def first_direction(rows: DataFrame, table: str, key: str) -> str:
    """The direction of a first click on a column: that of the table, else ``asc`` for text and ``desc`` for numbers."""
    expression, first = SORTS[table][key]
    return first or ("asc" if dict(rows.select(F.expr(expression).alias("x")).dtypes)["x"] == "string" else "desc")


def sort_table(rows: DataFrame, table: str, key: str, direction: str | None = None, collation: str | None = None) -> DataFrame:
    """Rows sorted by a column of a table; ties by name.  An unknown key leaves the rows as they are.

    Text sorts by code point, or by the rules of a ``collation`` such as ``UNICODE`` or ``de``:
    then letters come together whatever their case and accents, which decide among equals.
    """
    if key not in SORTS[table]:
        return rows
    direction = direction or first_direction(rows, table, key)
    by, ties = F.expr(SORTS[table][key][0]), F.col("sector" if table == "sectors" else "sym")
    if collation:
        text = dict(rows.select(by.alias("x")).dtypes)["x"] == "string"
        by, ties = F.collate(by, collation) if text else by, F.collate(ties, collation)
    return rows.orderBy(by.desc() if direction == "desc" else by.asc(), ties)


def order_by(rows: DataFrame, key: str | Column, descending: bool = False, ties: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Rows sorted by a key, ties by name."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.orderBy(key.desc() if descending else key.asc(), *ties)


def normal_flows(flows: DataFrame) -> DataFrame:
    """Rows (date, category, buy, sell, net): foreign categories become FII, the rest DII."""
    name = F.upper("category")
    side = F.when(name.contains("FII") | name.contains("FPI"), "FII").otherwise("DII")
    return flows.select("date", side.alias("category"), *[num_commas(F.col(c).cast("string")).alias(c) for c in ("buy", "sell", "net")])


def flow_tail(flows: DataFrame, rows: int = 60) -> DataFrame:
    return flows.orderBy(F.desc("date"), "category").limit(rows)


def flow_totals(tail: DataFrame) -> DataFrame:
    """Rows (category, total, last): rounded sums and the latest net of each side."""
    return tail.groupBy("category").agg(round_up_half(F.sum("net")).alias("total"), F.max_by("net", "date").alias("last"))
