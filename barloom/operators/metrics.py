"""Latest metrics of every active symbol, and sector scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numbers import clamp, percent_of, round_even
from barloom.operators.indicators import PERIODS, QUARTER, relative_strength

OTHER = "Other"


def sector_of(constituents: DataFrame) -> DataFrame:
    """Rows (symbol, sector): one industry a symbol, the first by name where lists disagree."""
    return constituents.where("industry is not null").groupBy("symbol").agg(F.min("industry").alias("sector"))


def stock_metrics(
    indicators: DataFrame, highs: DataFrame, sectors: DataFrame, bench: DataFrame, delivery: DataFrame | None = None
) -> DataFrame:
    """One row for each symbol that trades in the last session.

    ``indicators`` are bars on the session axis with grid columns and averages, ``highs`` the
    all-time highs, ``bench`` one row with the benchmark's quarter ratio (or null).
    """
    last = indicators.join(F.broadcast(indicators.agg(F.max("sess").alias("_last"))), F.col("sess") == F.col("_last")).where("close > 0")
    rows = last.join(highs, "symbol", "left").join(sectors, "symbol", "left").crossJoin(F.broadcast(bench))  # one row
    rows = rows.join(delivery, "symbol", "left") if delivery is not None else rows.withColumn("delivery_pct", F.lit(None).cast("double"))
    price = F.col("close")

    def change(base: str):
        return F.when(F.col(base) > 0, F.try_divide(price, F.col(base)) * 100 - 100).otherwise(F.lit(0.0))

    ath = F.greatest(F.coalesce("ath", F.lit(0.0)), price)
    below = lambda top: F.when(top > 0, F.greatest(F.lit(0.0), F.try_divide(top - price, top) * 100)).otherwise(F.lit(0.0))
    found = rows.select(
        F.col("symbol").alias("sym"),
        F.coalesce("sector", F.lit(OTHER)).alias("sector"),
        "date",
        price.alias("price"),
        change("prev").alias("chg1d"),
        change("close5").alias("chg1w"),
        below(ath).alias("dist_ath"),
        below(F.col("hi52")).alias("dist52"),
        F.col("since").alias("ath_since"),
        "ath_date",
        *[f"e{p}" for p in PERIODS],
        F.when(F.col("sess") >= QUARTER, relative_strength(price, F.col("close63"), F.col("bench"))).otherwise(F.lit(0.0)).alias("rs"),
        F.coalesce("volume", F.lit(0)).cast("double").alias("volume"),
        "delivery_pct",
        (F.coalesce("volume", F.lit(0)) * price).alias("turnover"),
    )
    found = found.withColumns({"is_ath": F.col("dist_ath") < 0.4, "is52": F.col("dist52") < 0.5})
    return found.withColumn("wk_break", ~F.col("is52") & (F.col("chg1w") > 3.5) & (F.col("dist52") < 6))


def sector_scores(metrics: DataFrame) -> DataFrame:
    """Rows (sector, count, adv, dec, dma_pct, new_highs, wk, score), best first; symbols without a sector are left out."""
    by = metrics.where(F.col("sector") != OTHER).groupBy("sector").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("chg1d") > 0).alias("adv"),
        F.count_if(F.col("price") > F.col("e50")).alias("_above"),
        F.count_if("is52").alias("new_highs"),
        F.avg("chg1w").alias("wk"),
    )
    part = clamp((F.col("wk") + 3) * 5, 0.0, 30.0) + F.least(F.lit(20.0), F.col("new_highs") / F.col("count") * 220)
    by = by.withColumns({"dec": F.col("count") - F.col("adv"), "dma_pct": percent_of(F.col("_above"), F.col("count"))})
    score = F.least(F.lit(99), F.greatest(F.lit(2), round_even(F.col("dma_pct") * 0.5 + part)))
    return by.withColumn("score", score.cast("long")).drop("_above").orderBy(F.desc("score"), "sector")


def sector_members(metrics: DataFrame) -> DataFrame:
    """Rows (sector, advancing, declining, members): members as structs of their figures, by symbol."""
    figures = F.struct("sym", "price", "chg1d", "chg1w", "dist_ath", "is_ath", "is52", "wk_break")
    return metrics.groupBy("sector").agg(
        F.count_if(F.col("chg1d") >= 0).alias("advancing"),
        F.count_if(F.col("chg1d") < 0).alias("declining"),
        F.sort_array(F.collect_list(figures)).alias("members"),
    )
