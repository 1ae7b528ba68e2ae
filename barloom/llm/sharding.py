"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are laid out by range in a total order, each partition sums its own bytes, and the
short list of partition totals gives every partition its offset.  A row's global offset is
then its partition's offset plus a running sum inside the partition, and the shards are
the equal slices of the whole length.  Groups of equal texts that take a good part of a shard
are placed first, whole, each in the emptiest shard; the slices then fill all shards up to one
level.  Only built-in DataFrame functions are used.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import settle, shuffle_width, stored

#: Bytes that every row takes besides its text.
ROW_BYTES = 16
#: Groups of equal texts of at least this part of a shard are placed before all others: at most 16 a shard.
GROUP_PART = 1 / 16


def with_offsets(rows: DataFrame, order: list[str], size: str, partitions: int | None = None) -> DataFrame:
    """Add ``at`` (bytes before the row) and ``rank`` (rows before it) in the order given.

    The order should be total up to rows that are alike: rows that tie in all of its columns
    are laid out in an unspecified order among themselves.
    """
    n = partitions or shuffle_width(rows.sparkSession)
    laid = settle(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # as many rows as there are partitions
    totals = laid.groupBy("part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_at"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_rank"),
    )
    inside = W.partitionBy("part").orderBy(*order)
    own = laid.withColumn("rank", F.row_number().over(inside) - 1).withColumn(
        "at", F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    )
    joined = own.join(F.broadcast(offsets), "part")  # one row a partition
    return joined.withColumns({"at": F.col("at") + F.col("part_at"), "rank": F.col("rank") + F.col("part_rank")}).drop(
        "part", "part_at", "part_rank"
    )


def _levelled(loads: list[int], rest: int) -> list[int]:
    """How much of ``rest`` each shard gets, so that those with less than a common level reach it."""
    order = sorted(range(len(loads)), key=lambda k: loads[k])
    held = 0
    for n, k in enumerate(order, 1):
        held += loads[k]
        level = (rest + held) / n
        if n == len(order) or level <= loads[order[n]]:
            break
    fills, given = [0] * len(loads), 0
    for k in order[:n]:
        fills[k] = max(0, round(level - loads[k]))
        given += fills[k]
    fills[order[0]] += rest - given
    return fills


def _cuts(placed: DataFrame, ends: list[int], most: float) -> list[int]:
    """First byte of every shard but the first, moved off the inside of groups of at most ``most`` bytes."""
    inner = [x for x in dict.fromkeys(ends[:-1]) if x]
    if not inner:
        return ends[:-1]
    # rows that hold a cut: at most one a cut
    table = F.array(*[F.lit(x).cast("long") for x in inner])
    crossed = placed.where(F.exists(table, lambda x: (x >= F.col("at")) & (x <= F.col("at") + F.col("size"))))
    runs = crossed.select("text_key").distinct()
    extents = (
        placed.join(F.broadcast(runs), "text_key")
        .groupBy("text_key")
        .agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("size")).alias("last"))
        .where((F.col("last") - F.col("first")) <= most)
        .collect()
    )
    moved = []
    for cut in ends[:-1]:
        for run in extents:
            if run["first"] < cut < run["last"]:
                cut = run["first"] if cut - run["first"] <= run["last"] - cut else run["last"]
                break
        moved.append(cut)
    return moved


def _shard_at(starts: list[int], total: int) -> Column:
    """The last shard that starts at or before a row's middle; a coarse index leaves few starts to look at."""
    middle, parts = F.col("at") + F.floor(F.col("size") / 2), 2 * len(starts)
    width = total // parts + 1
    first = [max(0, bisect.bisect_right(starts, k * width) - 1) for k in range(parts + 1)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    part = F.least(F.floor(middle / width), F.lit(parts - 1)).cast("int")
    low, high = longs(first)[part].cast("int"), longs(first)[part + 1].cast("int")
    near = F.slice(longs(starts), low + 2, F.greatest(high - low, F.lit(0)))
    return (low + F.size(F.filter(near, lambda x: x <= middle))).cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16 (null text: 16), ``text_crc32`` its unsigned
    CRC-32 (null text: that of no bytes).  Groups of equal texts that fit into a shard stay in
    one; larger groups are cut.  Groups of a sixteenth of a shard or more are placed first,
    the largest first, each in the emptiest shard.  All others are ordered by a hash of the
    text, then by id, and cut so that all shards are filled up to one level; a cut inside a
    group moves to the group's nearer end, so shards differ by about a sixteenth, or by more
    where large groups leave no better choice.  ``slot`` counts each shard's rows from 0
    without gaps.  Null ids come first among equal texts; repeated rows are all kept and may
    swap slots.  Fewer rows than shards leave some shards empty; an empty table gives an empty
    result.  Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    slim = stored(slim)
    total = slim.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    groups = slim.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    # at most 16 a shard
    large = groups.where((F.col("bytes") >= target * GROUP_PART) & (F.col("bytes") <= target)).orderBy(F.desc("bytes"), "text_key").collect() if total else []
    loads, own = [0] * shards, []
    emptiest = [(0, k) for k in range(shards)]
    for group in large:
        load, k = heapq.heappop(emptiest)
        own.append((group["text_key"], k))
        loads[k] = load + group["bytes"]
        heapq.heappush(emptiest, (loads[k], k))
    placing = F.from_json(F.lit(json.dumps([{"text_key": x, "shard": k} for x, k in own])), "array<struct<text_key:long,shard:int>>")
    homes = F.broadcast(docs.sparkSession.range(1).select(F.inline(placing)))
    rest = slim.join(homes, "text_key", "left_anti") if own else slim
    order = ["text_key", "text_crc32", "size", "id"]
    placed = settle(with_offsets(rest, order, "size"))
    left = total - sum(loads)
    ends = list(itertools.accumulate(_levelled(loads, left)))
    starts = sorted([0, *_cuts(placed, ends, target)]) if left else [0]
    named = placed.withColumn("shard", _shard_at(starts, left)).select("shard", *order)
    if own:
        named = named.unionByName(slim.join(homes, "text_key").select("shard", *order))
    ranked = with_offsets(named, ["shard", *order], "size").select("id", "size", "text_crc32", "shard", "rank")
    ranked = settle(ranked)
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return ranked.join(F.broadcast(firsts), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
