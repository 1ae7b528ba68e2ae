"""News: articles by symbol, feeds, stale symbols, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.categories import sentiment, without_suffix


def entity_rows(articles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (uuid, symbol, sentiment): each article's symbols, the last mention of one winning."""
    rows = articles.select("uuid", F.posexplode("entities").alias("pos", "e"))
    rows = rows.select("uuid", "pos", without_suffix(F.col("e.symbol")).alias("symbol"), F.col("e.sentiment_score").alias("sentiment"))
    rows = rows.join(wanted, "symbol", "left_semi") if wanted is not None else rows
    return rows.groupBy("uuid", "symbol").agg(F.max_by("sentiment", "pos").alias("sentiment"))


def feed(news: DataFrame, symbols: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """The newest articles, of the watched symbols if given."""
    rows = news.join(symbols, "symbol", "left_semi") if symbols is not None else news
    return rows.orderBy(F.desc("published_at"), "id", "symbol").limit(limit)


def stale_symbols(watch: DataFrame, news: DataFrame, limit: int = 5) -> DataFrame:
    """The watched symbols whose news were fetched longest ago; never fetched comes first."""
    last = news.groupBy("symbol").agg(F.max("fetched_at").alias("fetched_at"))
    rows = watch.join(last, "symbol", "left").withColumn("fetched_at", F.coalesce("fetched_at", F.lit(0)))
    return rows.orderBy("fetched_at", "symbol").limit(limit)


def sentiment_counts(news: DataFrame) -> DataFrame:
    return news.groupBy("symbol", sentiment(F.col("sentiment")).alias("mood")).agg(F.count("*").alias("articles"))


def with_sector(news: DataFrame, sectors: DataFrame) -> DataFrame:
    return news.join(sectors, "symbol", "left")


def symbol_counts(news: DataFrame, watch: DataFrame) -> DataFrame:
    """Rows (symbol, articles): how many articles there are, as ``all``, and of each watched symbol, none included."""
    counts = news.groupBy("symbol").agg(F.count("*").alias("articles"))
    each = watch.select("symbol").distinct().join(counts, "symbol", "left").na.fill(0, ["articles"])
    return each.unionByName(news.agg(F.count("*").alias("articles")).select(F.lit("all").alias("symbol"), "articles"))
