"""Readers of raw vendor files: zipped and plain CSV, fixed-record DAT, JSON.

Vendor files are small (one a session), so each is read whole by one task; many files are
read in parallel.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.labels import parse_date
from barloom.functions.numbers import num, whole

SERIES = ("EQ", "BE", "BZ")
#: First date of the newer column names.
NEW_LAYOUT = "2024-01-01"
# Column names of the two layouts of the daily file.
LAYOUTS = {
    "old": {
        "symbol": "symbol", "series": "series", "isin": "isin", "open": "open", "high": "high", "low": "low", "close": "close",
        "prev_close": "prevclose", "volume": "tottrdqty", "traded_value": "tottrdval", "trades": "totaltrades",
    },
    "new": {
        "symbol": "tckrsymb", "series": "sctysrs", "isin": "isin", "open": "opnpric", "high": "hghpric", "low": "lwpric", "close": "clspric",
        "prev_close": "prvsclsgpric", "volume": "ttltradgvol", "traded_value": "ttltrfval", "trades": "ttlnboftxsexctd",
    },
}
ROWS = "path string, row map<string,string>"


def _csv_maps(text: str) -> Iterator[dict[str, str]]:
    import csv

    lines = csv.reader(io.StringIO(text))
    names = [x.strip().lower() for x in next(lines, [])]
    for cells in lines:
        if any(c.strip() for c in cells):
            yield dict(zip(names, cells, strict=False))


def csv_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (path, row): each line of plain or zipped CSV files as a map by lower-cased header.

    Of a zip archive the first ``.csv`` member is read.  Bad UTF-8 is replaced, blank lines
    are skipped.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, blob in zip(files.path, files.content, strict=True):
                if blob[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                        member = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                        blob = archive.read(member) if member else b""
                found = list(_csv_maps(blob.decode("utf-8", "replace").lstrip("\ufeff")))
                yield pd.DataFrame({"path": [path] * len(found), "row": found})

    return files.mapInPandas(parse, ROWS)


def _cell(name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at(F.col("row"), F.lit(name)), F.lit("")))


def daily_bars(rows: DataFrame, date: Column) -> DataFrame:
    """Bars from ``csv_rows`` of the daily file; ``date`` tells the layout.  Only traded equity series stay."""
    dated = rows.withColumn("date", date)

    def mapped(names: dict[str, str]) -> list[Column]:
        text = {k: _cell(v) for k, v in names.items()}
        money = [num(text[c]).alias(c) for c in ("open", "high", "low", "close", "prev_close")]
        return [
            text["symbol"].alias("symbol"), F.col("date"), text["series"].alias("series"), F.nullif(text["isin"], F.lit("")).alias("isin"),
            *money, whole(text["volume"]).alias("volume"), num(text["traded_value"]).alias("traded_value"), whole(text["trades"]).alias("trades"),
        ]

    old = dated.where(F.col("date") < F.lit(NEW_LAYOUT).cast("date")).select(*mapped(LAYOUTS["old"]))
    new = dated.where(F.col("date") >= F.lit(NEW_LAYOUT).cast("date")).select(*mapped(LAYOUTS["new"]))
    return old.unionByName(new).where(F.col("series").isin(*SERIES) & (F.col("symbol") != "") & (F.col("close") > 0))


def index_bars(rows: DataFrame, date: Column) -> DataFrame:
    """Index bars from ``csv_rows`` of the all-indices file; names are upper-cased."""
    fields = {"open": "open index value", "high": "high index value", "low": "low index value", "close": "closing index value"}
    found = rows.select(F.upper(_cell("index name")).alias("index_name"), date.alias("date"), *[num(_cell(v)).alias(k) for k, v in fields.items()])
    return found.where((F.col("index_name") != "") & (F.col("close") > 0))


def security_report(rows: DataFrame) -> DataFrame:
    """The full security report, one row a symbol; a later line of a file wins."""
    names = {"prev_close": "prev_close", "open": "open_price", "high": "high_price", "low": "low_price", "close": "close_price", "volume": "ttl_trd_qnty", "delivery_pct": "deliv_per"}
    found = rows.select(
        _cell("symbol").alias("symbol"), _cell("series").alias("series"), F.monotonically_increasing_id().alias("_at"), *[num(_cell(v)).alias(k) for k, v in names.items()]
    ).where(F.col("series").isin(*SERIES) & (F.col("symbol") != ""))
    fields = [c for c in found.columns if c not in ("symbol", "_at")]
    return found.groupBy("symbol").agg(F.max_by(F.struct(*fields), "_at").alias("x")).select("symbol", "x.*")


def deliveries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (symbol, delivery_pct) of type-20 records of the delivery file."""
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(paths).select(cells.alias("f")).where("size(f) >= 7 and f[0] = '20'")
    return rows.where(F.col("f")[3].isin(*SERIES)).select(F.col("f")[2].alias("symbol"), num(F.col("f")[6]).alias("delivery_pct"))


def filings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (symbol, ex, subject) from JSON arrays of filings."""
    rows = spark.read.schema(schemas.FILINGS).json(paths, multiLine=True)
    return rows.select(F.trim("symbol").alias("symbol"), parse_date(F.col("exDate")).alias("ex"), F.trim("subject").alias("subject"))


def constituents(spark: SparkSession, lists: dict[str, str]) -> DataFrame:
    """Index members from one CSV an index; lines without a symbol are dropped."""
    blank = lambda name: F.nullif(_cell(name), F.lit(""))
    parts = []
    for name, path in lists.items():
        rows = csv_rows(spark, path).select(
            F.lit(name).alias("index_name"), blank("symbol").alias("symbol"), blank("company name").alias("name"),
            blank("industry").alias("industry"), blank("isin code").alias("isin"),
        )
        parts.append(rows.where("symbol is not null"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (date, category, buy, sell, net) from the two-day JSON of flows, as text yet."""
    rows = spark.read.schema(schemas.FLOWS).json(paths, multiLine=True)
    return rows.select(
        parse_date(F.col("date")).alias("date"), "category", F.col("buyValue").alias("buy"), F.col("sellValue").alias("sell"), F.col("netValue").alias("net")
    ).where("date is not null")


def articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """News articles with their nested entities."""
    return spark.read.schema(schemas.ARTICLES).json(paths, multiLine=True)
