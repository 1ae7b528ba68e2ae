"""Command line: ``python -m barloom COMMAND ROOT``: the nightly steps over a folder of curated tables.

``eod`` runs them all in order and publishes, ``analytics`` shows sector scores without
publishing.  The folder's layout is that of ``barloom.plans.nightly``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import adjust, audit
from barloom.plans import nightly
from barloom.sources import curated


def verify(spark: SparkSession, root: str) -> DataFrame:
    """Highs and lows of each symbol on adjusted bars."""
    return audit.derived_stats(adjust.adjusted_bars(curated.daily(spark, f"{root}/daily"), curated.actions(spark, f"{root}/corporate_actions")))


def summary(spark: SparkSession, root: str) -> DataFrame:
    return audit.lake_summary(curated.daily(spark, f"{root}/daily"))


def _pairs(text: str) -> tuple[str, str]:
    name, found, path = text.partition("=")
    if not found:
        raise argparse.ArgumentTypeError("write INDEX=FILE")
    return name, path


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("backfill", "indices", "reference", "actions", "analytics", "publish", "eod", "verify", "summary"):
        command = commands.add_parser(name)
        command.add_argument("root")
        if name in ("backfill", "indices", "actions", "eod"):
            command.add_argument("--files", required=True, help="vendor files: daily bars; for indices the file of all indices, for actions filings")
        if name in ("backfill", "indices", "eod"):
            command.add_argument("--date", required=True, help="the session of the files, as YYYY-MM-DD")
        if name in ("reference", "eod"):
            command.add_argument("--list", action="append", default=[], required=name == "reference", help="INDEX=FILE", type=_pairs)
        if name == "eod":
            command.add_argument("--indices", help="the file of all indices")
            command.add_argument("--filings", help="new filings")
        if name in ("analytics", "publish", "eod"):
            command.add_argument("--delivery", help="the delivery file of the session")
            command.add_argument("--benchmark", action="append", help="indices that strength is measured by, the first one found")
        if name == "verify":
            command.add_argument("symbol", nargs="?")
    given = parser.parse_args(args)
    spark, root = SparkSession.builder.appName("barloom").getOrCreate(), given.root
    delivery, benchmarks = getattr(given, "delivery", None), tuple(getattr(given, "benchmark", None) or nightly.MARKET)
    if given.command == "backfill":
        nightly.add_bars(spark, root, given.files, given.date)
    elif given.command == "indices":
        nightly.add_indices(spark, root, given.files, given.date)
    elif given.command == "reference":
        nightly.refresh_lists(spark, root, dict(given.list))
    elif given.command == "actions":
        nightly.refresh_actions(spark, root, given.files)
    elif given.command == "analytics":
        nightly.shot_of(spark, root, benchmarks, nightly.delivered(spark, delivery)).sectors.orderBy(F.desc("score"), "sector").show(50, truncate=False)
    elif given.command == "publish":
        nightly.publish(spark, root, benchmarks, nightly.delivered(spark, delivery))
    elif given.command == "eod":
        nightly.run(spark, root, given.date, nightly.Files(given.files, given.indices, dict(given.list), given.filings, delivery), benchmarks)
    elif given.command == "verify":
        rows = verify(spark, root)
        (rows.where(F.col("symbol") == given.symbol.upper()) if given.symbol else rows).show(50, truncate=False)
    else:
        summary(spark, root).show(50, truncate=False)


if __name__ == "__main__":
    main()
