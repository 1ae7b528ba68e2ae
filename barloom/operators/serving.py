"""Served tables: published together, read through one pointer, asked by parameterised SQL.

Every published table has a folder of its own that is never changed.  A small file names the
folders that are valid together, and replacing that file is the only step of a publication
that readers can see: before it they find the old state of all tables, after it the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import store

POINTER = "current.json"


class Served:
    """The tables under a folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path(POINTER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """{"version": n, "tables": {name: folder}, "before": the tables of the version before}."""
        files, path = self._files(), self._path(POINTER)
        if not files.exists(path):
            return {"version": 0, "tables": {}, "before": {}}
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def names(self) -> list[str]:
        return sorted(self.pointer()["tables"])

    def table(self, name: str) -> DataFrame:
        """A table as it was last published; what is read stays there until the version after the next."""
        return self.spark.read.parquet(f"{self.root}/{self.pointer()['tables'][name]}")

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables to folders of their own, which no reader sees yet."""
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"tables/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        return folders

    def point(self, folders: dict[str, str], expected: int | None = None) -> int:
        """Make folders the valid ones, all at once; other tables stay.  Returns the version.

        With ``expected``, a version that somebody else has published since raises instead.
        """
        jvm, now = self.spark._jvm, self.pointer()
        if expected is not None and now["version"] != expected:
            raise RuntimeError(f"version {now['version']} was published after version {expected}")
        new = {"version": now["version"] + 1, "tables": now["tables"] | folders, "before": now["tables"]}
        aside = self._path(f"{POINTER}.{uuid.uuid4().hex}")
        stream = self._files().create(aside)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        target = self._path(POINTER)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, over)
        return new["version"]

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Publish tables together; they may be computed from the ones that are served."""
        version = self.pointer()["version"]
        return self.point(self.write(tables), version)

    def clean(self) -> None:
        """Remove folders that neither this version nor the one before names, such as those of publications that broke off."""
        files, now = self._files(), self.pointer()
        kept = {*now["tables"].values(), *now["before"].values()}
        base = self._path("tables")
        if not files.exists(base):
            return
        for table in files.listStatus(base):
            for folder in files.listStatus(table.getPath()):
                name = f"tables/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in kept:
                    files.delete(folder.getPath(), True)

    def ask(self, sql: str, **params: object) -> DataFrame:
        """SQL over the served tables, written ``{name}``, with named parameters ``:name``, which are never part of the text."""
        used = {n: self.table(n) for n in self.names() if "{" + n + "}" in sql}
        return self.spark.sql(sql, args=params, **used)


#: Reads of the served tables, each with the parameters that it names.
READS = {
    "latest_stocks": "select * from {stock_metrics} where date = (select max(date) from {stock_metrics})",
    "stock": "select * from {stock_metrics} where sym = :symbol order by date desc limit 1",
    "sectors_of": "select * from {sector_scores} where date = cast(:date as date) order by score desc, sector",
    "breadth_since": "select * from {breadth_daily} where date >= cast(:date as date) order by date",
    "index_tail": "select * from {index_bars} where index_name = :name order by date desc limit :rows",
    "candles": "select * from {stock_candles} where symbol = :symbol",
    "meta": "select value from {meta} where key = :key",
    "log_of": "select * from {ingest_log} where job = :job and status = :status order by ts desc limit :rows",
}


def publish_session(served: Served, stocks: DataFrame, sectors: DataFrame, breadth: DataFrame, candles: DataFrame, indices: DataFrame, log: DataFrame | None = None, meta: DataFrame | None = None) -> int:
    """One nightly publication: the session's rows replace their like, and everything becomes visible at once.

    ``sectors`` and ``breadth`` have a ``date``; ``indices`` are rows (index_name, date, ...);
    ``log`` rows are appended, ``meta`` rows (key, value) replace those of their keys.
    """
    held = set(served.names())
    old = lambda name: served.table(name) if name in held else None

    def merged(name: str, new: DataFrame, how) -> DataFrame:
        before = old(name)
        return new if before is None else how(before, new)

    tables = {
        "stock_metrics": merged("stock_metrics", stocks, store.replace_session),
        "sector_scores": merged("sector_scores", sectors, store.replace_session),
        "breadth_daily": merged("breadth_daily", breadth, lambda a, b: store.upsert(a, b, ["date"])),
        "stock_candles": merged("stock_candles", candles, lambda a, b: store.upsert(a, b, ["symbol"])),
        "index_bars": merged("index_bars", indices, lambda a, b: store.upsert(a, b, ["index_name", "date"])),
    }
    if log is not None:
        tables["ingest_log"] = merged("ingest_log", log, lambda a, b: a.unionByName(b))
    if meta is not None:
        tables["meta"] = merged("meta", meta, lambda a, b: store.upsert(a, b, ["key"]))
    return served.publish(tables)
