"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name in a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``.

    A temporary one is set only where that is unset and the master is local, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="barloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet: smaller than a checkpoint, and of a size that Spark knows."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, row_col: str) -> DataFrame:
    """``df`` with a column of distinct longs, written to the shared folder.

    A number that is computed anew in each scan changes with the splits of the scan, which
    Spark derives from the cores of the moment; a stored one does not.
    """
    return stored(df.withColumn(row_col, F.monotonically_increasing_id()))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D (null: 0).

    Whole-string replacements alone: no array of words is made, nor a string a character.
    """
    plain = text
    for control in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(control), F.lit(" "))
    for mark in "\x01\x02":  # free for the marks below, as parts of words
        plain = F.replace(plain, F.lit(mark), F.lit("x"))
    plain = F.trim(plain)
    # a run of blanks becomes a run of the pair 1 2, of which all but the ends go
    marked = F.replace(F.replace(plain, F.lit(" "), F.lit("\x01\x02")), F.lit("\x02\x01"), F.lit(""))
    gaps = F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("\x01"), F.lit("")))
    return F.coalesce(F.when(plain == "", 0).otherwise(gaps + 1), F.lit(0)).cast("long")


def least_hashes(hashed: Column, part: float) -> Column:
    """Whether a 64-bit hash is among that share of all: whole longs are compared, so no share is too small to hold any."""
    return hashed <= F.lit(max(-(2**63), min(2**63 - 1, int(part * 2**64) - 2**63)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a sieve, as a power of two, at most; 16 MB.
SIEVE_BITS = 27


class Sieve:
    """A set of 64-bit hashes as an array of bits: no member is missed, others may pass."""

    def __init__(self, places, masks, bits: int) -> None:
        import numpy as np

        self.bits = bits
        self.table = np.zeros(1 << max(0, bits - 6), np.uint64)
        self.table[places] = masks

    def __call__(self, hashes):
        """Whether each of the unsigned numbers may be a member."""
        import numpy as np

        at = hashes >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def sieve(hashes: DataFrame) -> Sieve:
    """A sieve of a column of longs whose bits are evenly spread.

    What reaches the driver, and the tasks by a broadcast, is at most ``2 ** SIEVE_BITS`` bits
    however many values there are; a fuller sieve lets more other values pass.
    """
    import numpy as np

    held = F.col(hashes.columns[0])
    bits = min(SIEVE_BITS, max(10, math.ceil(math.log2(32 * hashes.count() + 1))))
    place = F.shiftrightunsigned(held, 64 - bits)
    spots = hashes.select(
        F.shiftrightunsigned(place, 6).alias("place"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashes.columns[0]}, {64 - bits}) & 63 as int))").alias("mask")
    )
    table = spots.groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Sieve(table.column("place").to_numpy(), table.column("mask").to_numpy().astype(np.int64).view(np.uint64), bits)


def sieved(rows: DataFrame, key_col: str, hashes: DataFrame) -> DataFrame:
    """The rows whose key is in ``hashes``, and a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(sieve(hashes))

    def passed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(key_col).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(shared.value(keys.view(np.uint64))))

    return rows.mapInArrow(passed, rows.schema)
