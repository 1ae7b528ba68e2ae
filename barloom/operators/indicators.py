"""Session-grid indicators: averages, extremes, changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.sessions import along

PERIODS = (10, 20, 50, 200)
YEAR, MONTH, WEEK, QUARTER = 252, 20, 5, 63
#: Most rows of a block of the averages' closed form.
BLOCK = 2000


def _keep(period: int) -> float:
    return 1.0 - 2.0 / (period + 1)


def _block_rows(periods: tuple[int, ...]) -> int:
    """Rows of a block such that the weights of the shortest period stay inside a double."""
    keep = min(_keep(p) for p in periods)
    return BLOCK if keep <= 0 else max(1, min(BLOCK, int(250 * math.log(10) / -math.log(keep))))


def with_emas(
    bars: DataFrame, periods: tuple[int, ...] = PERIODS, column: str = "close", order: str = "sess", most_rows: int | None = None
) -> DataFrame:
    """Add ``e<period>`` columns.  A session without a bar carries the average on.

    The average is a closed form over a running sum.  Its weights grow with the rows, so long
    histories are cut into blocks: a block's average is its own closed form plus the faded
    averages at the ends of the blocks before, as many as are above the precision of a double.
    ``most_rows`` is the number of rows that no symbol exceeds, if known: one block needs no
    more than the running sum.
    """
    rows = W.partitionBy("symbol").orderBy(order)
    size = _block_rows(periods)
    one = most_rows is not None and most_rows <= size
    out = bars.withColumn("_i", F.row_number().over(rows) - 1)
    out = out.withColumns({"_block": F.lit(0) if one else F.floor(F.col("_i") / size).cast("int"), "_at": F.col("_i") % size})
    running = (rows if one else W.partitionBy("symbol", "_block").orderBy(order)).rowsBetween(W.unboundedPreceding, 0)
    own = {}
    for p in periods:
        keep = _keep(p)
        weighted = F.when(F.col("_i") == 0, F.col(column)).otherwise(F.col(column) * (1 - keep) * F.pow(F.lit(keep), -F.col("_at")))
        own[f"e{p}"] = F.pow(F.lit(keep), F.col("_at")) * F.sum(weighted).over(running)
    out = out.withColumns(own)
    if not one:
        blocks = W.partitionBy("symbol").orderBy("_block")
        carried = {}
        for p in periods:
            keep, total = _keep(p), F.col(f"e{p}")
            back = 1 if keep <= 0 else max(1, math.ceil(18 * math.log(10) / (-math.log(keep) * size)))
            for m in range(1, back + 1):
                end = F.max(F.when(F.col("_at") == size - 1, F.col(f"e{p}"))).over(blocks.rangeBetween(-m, -m))
                total = total + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(keep), F.col("_at") + 1 + size * (m - 1))
            carried[f"e{p}"] = total
        out = out.withColumns(carried)
    return out.drop("_i", "_block", "_at")


def with_fillers(bars: DataFrame) -> DataFrame:
    """Add a row (symbol, sess) for each session without a bar between two bars of a symbol; ``_bar`` tells them apart."""
    until = F.coalesce(F.lead("sess").over(along()), F.col("sess") + 1)
    every = bars.withColumn("_until", until).withColumn("_s", F.explode(F.sequence("sess", F.col("_until") - 1)))
    mine = F.col("_s") == F.col("sess")
    kept = [F.when(mine, F.col(c)).alias(c) for c in bars.columns if c not in ("symbol", "sess")]
    return every.select("symbol", F.col("_s").alias("sess"), *kept, mine.alias("_bar"))


def with_extremes(filled: DataFrame, width: int = YEAR) -> DataFrame:
    """Add the highest high and lowest low of the last ``width`` sessions to rows without holes.

    Sessions are cut into blocks of the width.  A window then is the end of one block and the
    begin of the next, so the extremes run once forwards and once backwards through each
    block, and a row looks up two of them: the cost does not depend on the width.
    """
    block = W.partitionBy("symbol", "_block")
    back = block.orderBy(F.desc("sess")).rowsBetween(W.unboundedPreceding, 0)
    ahead = block.orderBy("sess").rowsBetween(W.unboundedPreceding, 0)
    rows = W.partitionBy("symbol").orderBy("_block", "sess")
    out = filled.withColumn("_block", F.floor(F.col("sess") / width))
    out = out.withColumns({"_back_hi": F.max("high").over(back), "_back_lo": F.min("low").over(back)})
    out = out.withColumns({"hi52": F.max("high").over(ahead), "lo52": F.min("low").over(ahead)})
    # before a symbol has that many sessions, the window begins with its first one; one block holds it by itself
    begun = F.first("_block").over(rows) < F.col("_block")
    found = {}
    for mine, c, best in (("hi52", "_back_hi", F.greatest), ("lo52", "_back_lo", F.least)):
        first = F.when(begun, F.first(c).over(rows))
        found[mine] = best(F.col(mine), F.when(F.row_number().over(rows) >= width, F.lag(c, width - 1).over(rows)).otherwise(first))
    return out.withColumns(found).drop("_back_hi", "_back_lo")


def with_grid(bars: DataFrame) -> DataFrame:
    """Add the lags, 52-week extremes and volume mean; all share one partitioning.

    Sessions without a bar are filled in for the while, so that a lag of sessions is one of rows.
    """
    rows = W.partitionBy("symbol").orderBy("_block", "sess")
    out = with_extremes(with_fillers(bars)).withColumns(
        {
            "prev": F.lag("close", 1).over(rows),
            "close5": F.lag("close", WEEK).over(rows),
            "close63": F.lag("close", QUARTER).over(rows),
            "vol20": F.when(F.col("sess") >= MONTH, F.avg("volume").over(rows.rowsBetween(-MONTH, -1))),
        }
    )
    change = F.try_divide(F.col("close") - F.col("prev"), F.col("prev")) * 100.0
    return out.where("_bar").withColumn("chg", change).drop("_bar", "_block")


def relative_strength(price: Column, base: Column, bench: Column) -> Column:
    """Return over a quarter against the benchmark's, in per cent; 0 without a base."""
    ratio = F.try_divide(F.try_divide(price, base), bench) * 100.0 - 100.0
    return F.when((base > 0) & (bench > 0), ratio).otherwise(F.lit(0.0))


def benchmark_ratio(index_bars: DataFrame, names: tuple[str, ...], quarter: int = QUARTER) -> DataFrame:
    """One row (bench): last close over the close ``quarter`` rows before, of the first named index with enough rows."""
    back = W.partitionBy("index_name").orderBy(F.desc("date"))
    rows = index_bars.where(F.col("index_name").isin(*names)).withColumn("_n", F.row_number().over(back) - 1)
    last, base = F.max(F.when(F.col("_n") == 0, F.col("close"))), F.max(F.when(F.col("_n") == quarter, F.col("close")))
    rank = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("index_name"))
    each = rows.groupBy("index_name").agg(last.alias("last"), base.alias("base"), F.count("*").alias("n")).where(F.col("n") > quarter + 1)
    return each.agg(F.min_by(F.when(F.col("base") > 0, F.col("last") / F.col("base")), rank).alias("bench"))
