"""Near-duplicate documents by SimHash, searched with pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are its
coordinates.  By the triangle inequality two fingerprints within 2 bits differ by at most 2
in every coordinate, so pairs with a larger difference are discarded before the exact test.

``REFERENCES`` pivots are spread over all 64 bits; the distances to them are computed once a
fingerprint, packed eight to a long, and stored.  Pairs that meet are discarded by them, and
only what is left is tested exactly.

Which pairs meet is told by further pivots: the zero fingerprint and, for each block of bits,
patterns that are zero outside the block.  Less the distance to the zero pivot, the
coordinates of a block's pivots depend on the bits of that block alone.  Of four blocks, two
fingerprints within 2 bits agree on at least two, hence share the coordinates of two whole
blocks: those are the keys of an equi-join that loses no pair.  A key that many fingerprints share is split: the two blocks
it leaves open are cut into four, of which again two agree, and the coordinates of their own
pivots go into the longer key.  After four such levels 4 bits are open, so a key is shared by
16 fingerprints at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle
from barloom.llm.components import connected_components

SEED = 42
#: Most differing bits of a link; four blocks of which two agree serve this radius.
RADIUS = 2
#: Bits of a block at each level, and random pivots of a block.
WIDTHS = (16, 8, 4, 2)
PIVOTS_PER_BLOCK = 12
#: Pivots of the stored distance table, and its columns of eight distances each.
REFERENCES = 32
TABLE = tuple(f"far{i}" for i in range(REFERENCES // 8))
#: Most fingerprints of one key that are compared in pairs; beyond it the key is split.
BUCKET = 48


def patterns(width: int) -> list[int]:
    """The pivots of a block of that width: random patterns, and each single bit, so that coordinates tell all blocks apart."""
    import numpy as np

    rng = np.random.default_rng([SEED, width])
    drawn = rng.choice(2**width - 1, min(PIVOTS_PER_BLOCK, 2**width - 1), replace=False) + 1
    return sorted({int(x) for x in drawn} | {1 << i for i in range(width)})


def references() -> list[int]:
    """The pivots of the stored table: random fingerprints of 64 bits."""
    import numpy as np

    return np.random.default_rng([SEED, REFERENCES]).integers(0, 2**64, REFERENCES, dtype=np.uint64).tolist()


def distances(fp: Column) -> list[Column]:
    """The columns of the table: distances to the references, a byte each."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(x)))).cast("long") for x in references()]
    return [reduce(Column.bitwiseOR, [F.shiftleft(far[at + i], 8 * i) for i in range(8)]).alias(name) for name, at in zip(TABLE, range(0, REFERENCES, 8), strict=True)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _words(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in runs of about ``limit`` bytes."""
    if len(text) <= limit:
        yield text.lower().split()
        return
    import re

    blank, at = re.compile(rb"[\x20\x09-\x0D]"), 0
    while at < len(text):
        cut = blank.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def _fingerprints(batches: Iterator, shingle: int) -> Iterator:
    """Arrow batches (id, text, ...) to (id, fingerprint)."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    base = np.arange(8, dtype=np.int64) * 256
    bit_of = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)

    def ones(hashes: list[int]) -> np.ndarray:
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + base
        return np.einsum("bv,vk->bk", np.bincount(octets.ravel(), minlength=2048).reshape(8, 256), bit_of).ravel()

    def fingerprint(text: bytes | None) -> int:
        total, counts, tail = 0, np.zeros(64, np.int64), []
        for words in _words(text or b""):
            words = tail + words
            for at in range(0, len(words) - shingle + 1, 1 << 16):
                part = words[at : at + (1 << 16) + shingle - 1]
                hashes = [digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)), strict=False)]
                counts += ones(hashes)
                total += len(hashes)
            tail = words[-(shingle - 1) :] if shingle > 1 else []
        if not total and tail:
            counts, total = ones([digest(b" ".join(tail), SEED)]), 1
        return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])

    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.fromiter((fingerprint(x) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp): the 64-bit SimHash of every row's word shingles, as a signed long.

    Texts are lower-cased in A-Z and cut at space and U+0009 to U+000D.  Fewer words than
    ``shingle`` count as one shingle; no words (null and empty texts) give zero.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _fingerprints(it, shingle), f"id {kind}, fp long")


def near(x: str, y: str) -> Column:
    """Whether no stored distance of the rows of those aliases differs by more than the radius."""
    def byte(side: str, name: str, at: int) -> Column:
        return F.shiftright(F.col(f"{side}.{name}"), at).bitwiseAND(F.lit(255))

    return reduce(Column.__and__, [F.abs(byte(x, name, at) - byte(y, name, at)) <= RADIUS for at in range(0, 64, 8) for name in TABLE])


def _split(keyed: DataFrame, width: int) -> DataFrame:
    """Rows (key, fp, one, two) and the stored distances to those of the next level, whose keys hold two blocks more.

    ``one`` and ``two`` are the first bits of the open blocks, each twice ``width`` wide; at
    the first level, 0 and 32.
    """
    starts = [F.col("one"), F.col("one") + width, F.col("two"), F.col("two") + width]

    def coordinates(start: Column) -> Column:
        """The distances to the block's pivots, less that to the zero pivot: they depend on the block alone."""
        own = F.call_function("shiftrightunsigned", F.col("fp"), start).bitwiseAND(F.lit(2**width - 1))
        return F.xxhash64(*[F.bit_count(own.bitwiseXOR(F.lit(x))) - F.bit_count(own) for x in patterns(width)])

    choices = []
    for n, (a, b) in enumerate(itertools.combinations(range(4), 2)):
        left = [starts[x] for x in range(4) if x not in (a, b)]
        key = F.xxhash64("key", F.lit(n), F.col("c")[a], F.col("c")[b])
        choices.append(F.struct(key.alias("key"), left[0].cast("int").alias("one"), left[1].cast("int").alias("two")))
    held = keyed.withColumn("c", F.array(*[coordinates(x) for x in starts]))
    return held.select("fp", *TABLE, F.inline(F.array(*choices)))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The pairs (a, b) of fingerprints (column ``fp``, distinct) within 2 bits; a pair may come more than once."""
    def pairs(rows: DataFrame) -> DataFrame:
        x, y = rows.select("key", "fp", *TABLE).alias("x"), rows.select("key", "fp", *TABLE).alias("y")
        left = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near("x", "y"))
        met = left.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
        return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    table = settle(prints.select("fp", *distances(F.col("fp"))))
    keyed = table.select("fp", *TABLE, F.lit(0).cast("long").alias("key"), F.lit(0).alias("one"), F.lit(32).alias("two"))
    found = None
    for width in WIDTHS:
        keyed = settle(_split(keyed, width))
        frequent = settle(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"))
        last = width == WIDTHS[-1] or frequent.isEmpty()
        part = pairs(keyed if last else keyed.join(frequent, "key", "left_anti"))
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        keyed = keyed.join(frequent, "key", "left_semi")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """Rows (id, fp, component): every row's fingerprint and its component's smallest id.

    Rows of equal fingerprints form one class and only classes are compared, so exact
    copies cost nothing.  Null and empty texts have fingerprint zero and link like any
    other.  Null ids take part but are never a component's name unless all its ids are
    null.  Repeated rows come back as often as they were given; other columns are ignored.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(classes.select("fp")))
    named = settle(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    joined = roots.select("root").distinct().join(named, "root")  # classes that stand alone need no minimum
    names = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(names, "root", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return prints.join(labels, "fp").select("id", "fp", "component")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
