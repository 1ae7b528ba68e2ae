"""Mix sources to target weights with whole documents, by pivotal dependent rounding.

Each source has a target number of words, so each of its documents a rate: the whole part
is its sure copies, the fraction a probability to be rounded.  Rounding takes two
documents at a time and moves expected words from one to the other, at random in a way
that keeps each expectation, until one probability is 0 or 1.  The source's expected words
never change on the way, so its taken words end within one document of the target.

Pairs are first made inside deterministic blocks of documents of one source and similar
size; each block leaves at most one unrounded document, and a reduction tree rounds these
leftovers with each other, from blocks to size classes.  At the root a source has one
leftover a size class: each is rounded, largest first, against all smaller ones together,
so that a large document's rounding is made up for by many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import settle, shuffle_width, word_count
from barloom.llm.sharding import with_offsets

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents of a block, about; and blocks that meet in a step of the reduction tree.
BLOCK = 4096
FAN_IN = 16
SEED = 20240501


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources are ranked by code point, null last, and take the weights in turn.  They share
    ``share`` times all words by weight; a source whose part exceeds ``most`` times its own
    words stops there, and the rest is shared again until none is above.
    """
    sums = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = with_offsets(
        sums.withColumns({"last": F.col("source").isNull(), "one": F.lit(1)}), ["last", "source"], "one"
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = settle(ranked.select("source", "source_size", turn[(F.col("rank") % len(weights)).cast("int")].alias("w")))
    cap = F.col("source_size") * most
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # ends when no more sources are capped; two sums a round reach the driver
        above = cap <= F.lit(level) * F.col("w")
        sure, open_w = weighed.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("w")))).first()
        if not open_w or (new := max(0.0, total - (sure or 0.0)) / open_w) <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(cap, F.lit(level) * F.col("w")).alias("target"))


def _uniform(*keys: object) -> float:
    """A number in [0, 1) that depends on the keys alone."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(map(str, keys)).encode(), SEED) / 2**64


EDGE = 1e-9


def _done(row: dict, p: float) -> dict:
    return row | {"p": None, "extra": int(p > 0.5)}


def _pair(a: dict, b: dict) -> list[dict]:
    """Move words between two rows until one is rounded; that one comes first."""
    up = min((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that a may gain from b
    down = min(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    gain = up if _uniform(a["id"], a["size"], b["id"], b["size"], a["p"]) * (up + down) < down else -down
    pair = [a | {"p": a["p"] + gain / a["size"]}, b | {"p": b["p"] - gain / b["size"]}]
    pair.sort(key=lambda x: min(x["p"], 1 - x["p"]))
    return [_done(pair[0], pair[0]["p"]), pair[1] if EDGE < pair[1]["p"] < 1 - EDGE else _done(pair[1], pair[1]["p"])]


def _root(rows: list[dict]) -> Iterator[dict]:
    """Round a source's leftovers, one a size class and largest first, each against the smaller ones.

    Rounding up takes words from the smaller rows and rounding down gives them, in shares
    that fit either way, which keeps every expectation.
    """
    rows = sorted(rows, key=lambda x: (-x["size"], x["order"], str(x["id"])))
    for i, row in enumerate(rows):
        p, size, rest = row["p"], row["size"], rows[i + 1 :]
        fits = [min((1 - x["p"]) * x["size"] / p, x["p"] * x["size"] / (1 - p)) / size if EDGE < p < 1 - EDGE else 0.0 for x in rest]
        part = 1 / max(1.0, sum(fits))
        up = _uniform(row["id"], row["order"], size, p) < p
        for x, fit in zip(rest, fits, strict=True):
            moved = (p - up) * size * fit * part
            x["p"] = min(1.0, max(0.0, x["p"] + moved / x["size"]))
        yield _done(row, float(up))


def _round(batches: Iterator, key: list[str], last: bool) -> Iterator:
    """Pivotal rounding along the rows of each group, which come sorted and whole in a partition.

    ``p`` is a row's probability, null once it is rounded; ``extra`` is then 0 or 1.  One row
    is held at a time, at the root the few leftovers of one source.
    """
    import pyarrow as pa

    held: list[dict] = []
    group = schema = None
    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            now = [row[k] for k in key]
            if held and now != group:
                out += _root(held) if last else held
                held = []
            group = now
            held.append(row)
            if not last and len(held) == 2:
                first, second = _pair(*held)
                out.append(first)
                held = [second] if second["p"] is not None else out.append(second) or []
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist(list(_root(held)) if last else held, schema=schema)


def _level(rows: DataFrame, key: list[str], last: bool) -> DataFrame:
    laid = rows.repartition(shuffle_width(rows.sparkSession), *key).sortWithinPartitions(
        *key, F.desc("size"), "order", "id"
    )
    return settle(laid.mapInArrow(lambda it: _round(it, key, last), laid.schema))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    keep: Column | None = None,
) -> DataFrame:
    """Rows (id, source, size, source_size, target, copies) for every row of ``docs``.

    ``size`` counts the words of the text (null and blank texts: 0).  ``copies`` is how
    often the mix takes the row, never more than ``most`` rounded up; copies times size sum
    up to each source's target within one document.  Rows of size 0 are never taken.  Null
    sources form one source, ranked last.  Repeated rows are rounded separately, null ids
    like any other.  The same table gives the same copies on every run.  ``keep``, if given,
    is a column that is passed on as ``kept``.  An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        # rows of one id are told apart by their texts, and null ids spread over the blocks
        F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))).alias("order"),
        *([keep.alias("kept")] if keep is not None else []),
    )
    sized = settle(sized)
    targets = source_targets(sized, weights, share, most)
    same = sized.source.eqNullSafe(targets.source)
    rated = sized.join(targets, same).select(sized["*"], "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(F.floor(rate))
    units = rated.withColumns({"whole": F.when(F.col("size") > 0, whole).otherwise(0).cast("long"), "p": rate - whole})
    units = units.withColumns(
        {
            "open": (F.col("size") > 0) & (F.col("p") > 1e-9),
            "grade": F.floor(F.log2(F.col("size") + 1) * 2).cast("int"),
        }
    )
    # blocks of similar sizes; their number follows the exact count, so no block is large
    counts = units.where("open").groupBy("source", "grade").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    here = units.source.eqNullSafe(counts.source) & (units.grade == counts.grade)
    units = units.join(counts, here, "left").select(units["*"], F.coalesce("blocks", F.lit(1)).alias("blocks"))
    units = settle(units.withColumn("block", F.pmod(F.col("order"), F.col("blocks"))).withColumn("extra", F.lit(None).cast("long")))

    names = [c for c in units.columns if c not in ("open", "blocks")]
    most_blocks = units.agg(F.max("blocks")).first()[0] or 1
    rest, parts = units.where("open").select(names), [units.where("not open").select(names)]
    while True:
        rest = _level(rest, ["source", "grade", "block"], False)
        parts.append(rest.where("p is null"))
        rest = rest.where("p is not null")
        if most_blocks == 1:
            break
        most_blocks = -(-most_blocks // FAN_IN)
        rest = rest.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    parts.append(_level(rest, ["source"], True))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    kept = ["kept"] if keep is not None else []
    return every.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *kept)
