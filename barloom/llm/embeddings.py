"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised, so cosine ``c`` is Euclidean distance ``sqrt(2 - 2c)``.  A table
hashes a vector by Gaussian projections, shifted and cut into cells of width ``WIDTH``;
vectors that meet in a cell of any table are compared.

To the tables go ids and signatures: the signs of 192 further projections.  Two vectors whose
signatures differ in more bits than all but ``MISS`` of the pairs at the threshold do are set
aside; only vectors that have a partner left in a cell are fetched and compared by exact cosine.

How many projections a table has and how many tables there are follows from the number of
vectors of the largest label, so that a vector meets about ``FAR`` unrelated ones (cosine 0) a
table, and from the recall at the threshold.  At cosine 0.93 one projection agrees with
probability 0.881; 6 projections and 9 tables find such a pair with 0.995 and serve up to
60,000 vectors a label.  From there on the tables grow about as the vectors to the power 0.25.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle, shuffle_width, sieve, stored
from barloom.llm.components import connected_components
from barloom.llm.verify import pairs_within, whole_blocks

#: Many strangers a cell are cheap, since signatures sort them out; tables are not, since each gets all vectors' signatures.
WIDTH, RECALL, FAR, SEED = 2.5, 0.995, 2000, 11
LEAST_PROJECTIONS = 6
#: Share of the pairs at the threshold that each of the two tests of signatures may lose.
MISS = 1e-6
#: Vectors of a cell that are compared in one block; larger cells become pairs of blocks.
BLOCK = 8192
#: Rows of such a product at once, and vectors of a block from which on it is one.
STRIP, MATRIX = 512, 128
#: Rows whose signatures are compared with a block's at once, few enough to stay in a processor's cache.
SIGNED_STRIP = 32


def agreement(cosine: float, width: float = WIDTH) -> float:
    """The probability that one projection puts two unit vectors of that cosine into one cell."""
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    if distance == 0:
        return 1.0
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    """Projections of a table and number of tables."""

    projections: int
    tables: int


def plan(vectors: int, threshold: float, recall: float = RECALL) -> Plan:
    """For the number of vectors of a label, and the recall at the threshold."""
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(1.0, vectors / FAR)) / -math.log(agreement(0.0))))
    meet = agreement(threshold) ** projections
    return Plan(projections, math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet < 1 else 1)


def most_apart(bits: int, threshold: float, miss: float = MISS) -> int:
    """The number of sign bits of which a pair at the threshold differs in more with probability ``miss`` at most."""
    part = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    left, at = 1.0, -1
    while left > miss and at < bits:
        at += 1
        left -= math.comb(bits, at) * part**at * (1 - part) ** (bits - at)
    return at


class Tables:
    """The random projections for vectors of one length; the same in every process."""

    def __init__(self, dim: int, of: Plan) -> None:
        import numpy as np

        rng = np.random.default_rng([SEED, dim])
        self.plan, total = of, of.projections * of.tables
        self.directions = rng.standard_normal((dim, total))
        self.shifts = rng.uniform(0, WIDTH, total)
        self.mixers = rng.integers(1, 2**63, (of.tables, of.projections), dtype=np.int64) | 1
        self.signs = np.random.default_rng([SEED, dim, 1]).standard_normal((dim, 192))

    def cells(self, unit, tables: int):
        """One 64-bit cell number for each vector and each of the first ``tables`` tables."""
        import numpy as np

        used = tables * self.plan.projections
        steps = np.floor((unit @ self.directions[:, :used] + self.shifts[:used]) / WIDTH).astype(np.int64)
        mixed = (steps.reshape(-1, tables, self.plan.projections) * self.mixers[:tables]).sum(2)
        return (mixed ^ (mixed >> 29)) * np.int64(-7046029254386353131) + np.arange(tables)


    def signatures(self, unit):
        """Three longs of signs for each vector."""
        import numpy as np

        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


_TABLES: dict[tuple[int, Plan], Tables] = {}


def _tables(dim: int, of: Plan) -> Tables:
    if (dim, of) not in _TABLES:
        _TABLES[dim, of] = Tables(dim, of)
    return _TABLES[dim, of]


def _prepared(batches: Iterator) -> Iterator:
    """(id, label, vector) to (id, key, pool, raw): usable vectors get a digest, a hash of label and length, and their bytes."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        lists = batch.column(2)
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
        values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN, -0 becomes 0
        ends = np.cumsum(sizes)
        keys, pools, raws = [], [], []
        for label, a, b in zip(batch.column(1).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            own = values[a:b]
            if label is None or a == b or not np.isfinite(own).all() or not own.any():
                keys.append(None)
                pools.append(None)
                raws.append(None)
                continue
            raws.append(own.tobytes())
            name = f"{len(own)} {label}".encode("utf-8", "replace")
            keys.append(xxhash.xxh3_128_digest(name + b"\0" + raws[-1]))
            pools.append(xxhash.xxh64_intdigest(name) - 2**63)
        columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(pools, pa.int64()), pa.array(raws, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "pool", "raw"])


def _units(raws: list[bytes], kind: str):
    """Normalised vectors of one length, in double precision."""
    import numpy as np

    vectors = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(float)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _hashed(batches: Iterator, of: Plan, kind: str, keep) -> Iterator:
    """(id, pool, raw) to one row a table whose cell passes ``keep``: (id, table, cell, one, two, three), the last three the signature."""
    import numpy as np
    import pyarrow as pa

    table = np.arange(of.tables, dtype=np.int32)
    for batch in batches:
        ids, pools, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        size = np.array([len(x) for x in raws])
        for length in sorted(set(size.tolist())):
            rows = np.nonzero(size == length)[0]
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                unit = _units([raws[i] for i in part], kind)
                drawn = _tables(unit.shape[1], of)
                cells = (drawn.cells(unit, of.tables) ^ pools[part, None]) * np.int64(-4658895280553007687)
                signs = np.repeat(drawn.signatures(unit), of.tables, 0)
                columns = [np.repeat(ids[part], of.tables), np.tile(table, len(part)), cells.ravel(), *signs.T]
                kept = keep(columns[2])
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], ["id", "table", "cell", "one", "two", "three"])


def _partnered(batches: Iterator, limits: tuple[int, int]) -> Iterator:
    """Of rows that come sorted by cell and block, those with another of their block within the limits of the signatures."""
    import numpy as np
    import pyarrow as pa

    for rows, starts in whole_blocks(batches, ("cell", "low", "high")):
        one, two, three = (rows.column(x).to_numpy().view(np.uint64) for x in ("one", "two", "three"))
        side, low, high = (rows.column(x).to_numpy() for x in ("side", "low", "high"))
        size, stay = np.diff(np.append(starts, len(one))), np.zeros(len(one), bool)

        def meet(i, j, one=one, two=two, three=three, side=side, low=low, high=high, stay=stay) -> None:
            apart = np.bitwise_count(one[i] ^ one[j]) + np.bitwise_count(two[i] ^ two[j]) + np.bitwise_count(three[i] ^ three[j])
            near = (apart <= limits[1]) & ((low[i] == high[i]) | (side[i] != side[j]))
            stay[i[near]] = stay[j[near]] = True

        for start, n in zip(starts[size > MATRIX].tolist(), size[size > MATRIX].tolist(), strict=True):
            for at in range(start, start + n, SIGNED_STRIP):
                i, j = np.nonzero(np.bitwise_count(one[at : at + SIGNED_STRIP, None] ^ one[None, at : start + n]) <= limits[0])
                later = j > i
                meet(i[later] + at, j[later] + at)
        where = np.nonzero(np.repeat(size <= MATRIX, size))[0]
        if len(where):
            small = np.cumsum(np.append(0, size[size <= MATRIX]))[:-1]
            for i, j in pairs_within(small, len(where)):
                i, j = where[i], where[j]
                near = np.bitwise_count(one[i] ^ one[j]) <= limits[0]
                meet(i[near], j[near])
        yield rows.filter(pa.array(stay)).select(["id", "table", "cell", "side", "low", "high"])


def _near(unit, side, threshold: float):
    """Pairs of rows of a block within the threshold, a strip of rows at a time."""
    import numpy as np

    left, right = [], []
    for at in range(0, len(unit), STRIP):
        near = unit[at : at + STRIP] @ unit[at:].T >= threshold
        i, j = np.nonzero(np.triu(near, 1))
        left.append(i + at)
        right.append(j + at)
    i, j = np.concatenate(left), np.concatenate(right)
    if side.min() != side.max():  # a pair of blocks: pairs inside a block are dealt with elsewhere
        i, j = i[side[i] != side[j]], j[side[i] != side[j]]
    return i, j


def _links(rows, starts, threshold: float, of: Plan, kind: str):
    """(a, b, links) of whole blocks of cells; a pair counts in the first table where it meets."""
    import numpy as np
    import pyarrow as pa

    raws = rows.column("raw").to_pylist()
    ids, pool, side, low, high, table, weight = (rows.column(x).to_numpy() for x in ("id", "pool", "side", "low", "high", "table", "n"))
    unit, size = _units(raws, kind), np.diff(np.append(starts, len(ids)))
    left, right = [], []
    for start, n in zip(starts[size > MATRIX].tolist(), size[size > MATRIX].tolist(), strict=True):
        i, j = _near(unit[start : start + n], side[start : start + n], threshold)
        left.append(i + start)
        right.append(j + start)
    # small blocks are compared together, pair by pair
    small = np.repeat(size <= MATRIX, size)
    where = np.nonzero(small)[0]
    for i, j in pairs_within(np.concatenate([[0], np.cumsum(size[size <= MATRIX])[:-1]]) if len(where) else np.zeros(0, np.int64), len(where)):
        i, j = where[i], where[j]
        # cell numbers may happen to be equal; pairs inside one of two blocks are dealt with elsewhere
        near = (pool[i] == pool[j]) & ((low[i] == high[i]) | (side[i] != side[j]))
        i, j = i[near], j[near]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        left.append(i[near])
        right.append(j[near])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    i, j = i[pool[i] == pool[j]], j[pool[i] == pool[j]]
    if len(i) and table[i].max():
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        last = int(table[i].max())
        cells, a, b = _tables(unit.shape[1], of).cells(unit[used], last), place[: len(i)], place[len(i) :]
        for earlier in range(last):  # pairs that met before go; few tables leave few of them
            new = (earlier >= table[i]) | (cells[a, earlier] != cells[b, earlier])
            i, j, a, b = i[new], j[new], a[new], b[new]
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root = np.arange(len(ids))
    while True:  # smallest row number that a row is linked with, through any number of links
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = np.nonzero(links)[0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], ids[root[some]], links[some].astype(np.int64))], ["a", "b", "links"])


def _compared(batches: Iterator, threshold: float, of: Plan, kind: str) -> Iterator:
    """Rows that come sorted by cell and block, whole in a partition, to (a, b, links)."""
    import numpy as np
    import pyarrow as pa

    keys = ("cell", "low", "high")
    for rows, starts in whole_blocks(batches, keys):
        size = np.array([len(x) for x in rows.column("raw").to_pylist()])
        for length in sorted(set(size.tolist())):  # one, but for cell numbers that happen to be equal
            part = rows if (size == length).all() else rows.filter(pa.array(size == length))
            if part is not rows:
                key = [part.column(x).to_numpy() for x in keys]
                starts = np.nonzero(np.append(True, np.any([x[1:] != x[:-1] for x in key], 0)))[0]
            yield _links(part, starts, threshold, of, kind)


def _dealt(slim: DataFrame, of: Plan, kind: str) -> DataFrame:
    """Rows (id, table, cell, one, two, three, side, low, high): every vector in every table; crowded cells become pairs of blocks.

    Which cells are crowded is told by a sieve, and exactly by a join for what passes it.
    """
    import numpy as np

    schema = "id long, table int, cell long, one long, two long, three long"
    cells = slim.mapInArrow(lambda it: _hashed(it, of, kind, lambda x: np.ones(len(x), bool)), schema)
    sizes = cells.groupBy("cell").count().where(F.col("count") > BLOCK)
    crowded = settle(sizes.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    nil = F.lit(0)
    if crowded.isEmpty():
        return cells.withColumns({x: nil for x in ("side", "low", "high")})
    marks = slim.sparkSession.sparkContext.broadcast(sieve(crowded.select("cell")))
    plain = slim.mapInArrow(lambda it: _hashed(it, of, kind, lambda x: ~marks.value(x.view(np.uint64))), schema)
    held = slim.mapInArrow(lambda it: _hashed(it, of, kind, lambda x: marks.value(x.view(np.uint64))), schema)
    split = held.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("side", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(nil, F.col("blocks") - 1)))
    split = split.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    return plain.withColumns({x: nil for x in ("side", "low", "high")}).unionByName(split.drop("blocks", "other"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (id, n_links, component) for every row of ``vectors``.

    Rows are compared only if their labels are equal and not null.  ``n_links`` is the
    number of other rows within ``threshold``, ``component`` the smallest id reachable.
    Equal vectors of a label form one class, named by a hash, and only classes are hashed.
    Vectors that are null, empty or zero, or hold a null or a non-finite number, link with
    nothing, not even with their copies; neither do vectors of different lengths.  Ids are long
    integers; a null id takes part and is never a component's name unless all ids are null.
    Repeated rows count as several.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector")
    )
    rows = stored(rows.mapInArrow(_prepared, "id long, key binary, pool long, raw binary"))
    grouped = rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.first("pool").alias("pool"), F.first("raw").alias("raw")
    )
    # classes are numbered by a hash of their key, so that null and repeated ids do no harm
    classes = stored(grouped.withColumn("class", F.xxhash64("key")))
    largest = classes.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
    of = plan(largest, threshold)
    slim = classes.select(F.col("class").alias("id"), "pool", "raw")
    dealt = _dealt(slim, of, kind).repartition(shuffle_width(spark), "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "id")
    limits = (most_apart(64, threshold), most_apart(192, threshold))
    partnered = stored(dealt.mapInArrow(lambda it: _partnered(it, limits), "id long, table int, cell long, side int, low int, high int"))
    units = classes.select(F.col("class").alias("id"), "pool", "n", "raw")
    laid = partnered.join(units, "id").repartition(shuffle_width(spark), "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "id")
    found = settle(laid.mapInArrow(lambda it: _compared(it, threshold, of, kind), "a long, b long, links long"))

    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"))
    named = classes.select("class", "key", "n", "least").join(counts, F.col("class") == F.col("a"), "left").drop("a")
    named = named.join(roots, F.col("class") == F.col("node"), "left")
    named = settle(named.select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(names, "root").select("key", (F.col("n") - 1 + F.col("links")).cast("long").alias("n_links"), "component")
    linked = rows.join(labels, "key").select("id", "n_links", F.coalesce("component", "id").alias("component"))
    # unusable vectors have no key, so they need no join
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
