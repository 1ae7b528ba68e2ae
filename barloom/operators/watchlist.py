"""Watchlists: rows (user_id, symbol), a user's symbols by name, at most a few hundred each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import store
from barloom.operators.screens import import_symbols

MOST = 200


def listing(watch: DataFrame, user: object) -> DataFrame:
    return store.lookup(watch, user_id=user).select("symbol").orderBy("symbol")


def add(watch: DataFrame, user: object, asked: DataFrame, most: int = MOST) -> DataFrame:
    """The table with the symbols of ``asked`` (pos, symbol) added to a user's list, within the room left."""
    new = import_symbols(asked, listing(watch, user), most).select("symbol")
    kind = watch.schema["user_id"].dataType
    return store.insert_absent(watch, new.select(F.lit(user).cast(kind).alias("user_id"), "symbol"), ["user_id", "symbol"])


def remove(watch: DataFrame, user: object, symbol: str) -> DataFrame:
    kind = watch.schema["user_id"].dataType
    gone = watch.sparkSession.range(1).select(F.lit(user).cast(kind).alias("user_id"), F.lit(symbol.strip().upper()).alias("symbol"))
    return store.delete_keys(watch, gone, ["user_id", "symbol"])
