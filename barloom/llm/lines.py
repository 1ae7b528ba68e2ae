"""Fuzzy line deduplication by MinHash over character shingles.

Lines are compared trimmed and lower-cased.  Equal lines form one class, named by a 64-bit
hash, and only classes are compared.  A class's signature has one minimum for each of
``BANDS * ROWS`` bins (each shingle is hashed once, into one bin; empty bins borrow from
others in a fixed random order).  Classes that agree in all rows of a band are candidates;
at Jaccard 0.8 a band agrees with probability 0.33 and 16 bands find the pair with 0.998; at
0.4, where long lines of one language often are, a band agrees with 0.01.

Texts are read three times, and what leaves the tasks is small: first the hash, the band hashes
and a sketch of each different line; later the lines that are verified, which a sieve of their
hashes picks out.  See ``verify`` for how candidates are verified and linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Sieve, settle, sieve, sieved, stored
from barloom.llm.verify import BINS, Hashes, grouped, linked, packed, packed_rows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 16, 5, 23
#: Lines of a band that are compared in one block.
BLOCK = 1024
CHUNK = 1 << 16
_EMPTY = 0xFFFFFFFF


def _runs(codes, k: int):
    """Hashes of all runs of ``k`` numbers."""
    import numpy as np

    count = max(0, len(codes) - k + 1)
    hashed = codes[:count] + np.uint64(1)
    for i in range(1, k):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += codes[i : i + count]
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(29)
    return hashed


class Signer:
    """Band hashes and sketches of lines; the same in every process."""

    def __init__(self, shingle: int) -> None:
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.shingle, self.bins = shingle, BANDS * ROWS
        #: bins that both the band minima and the sketch's minima are made of
        self.fine = math.lcm(self.bins, BINS)
        others = [rng.permutation([x for x in range(self.bins) if x != b]) for b in range(self.bins)]
        self.lenders = np.array(others)
        self.mixers = rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

    def minima(self, lines: list[str]):
        """The smallest hash in each of the fine bins; lines shorter than a shingle are filled up with zeros."""
        import numpy as np

        k = self.shingle
        padded = "".join([x + "\0" * max(1, k - len(x)) for x in lines])
        codes = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        sizes = np.array([len(x) + max(1, k - len(x)) for x in lines])
        hashed = _runs(codes, k)
        last = np.cumsum(sizes)
        at = np.repeat(np.arange(len(lines)) * self.fine, sizes)[: len(hashed)]
        at += ((hashed >> np.uint64(32)) * np.uint64(self.fine) >> np.uint64(32)).view(np.int64)
        # the zero that closes a line belongs to no shingle, nor do runs over the end of a line
        for i in range(1, k + 1):
            outside = last - np.minimum(i, sizes - 1)
            at[outside[outside < len(at)]] = len(lines) * self.fine
        table = np.full(len(lines) * self.fine + 1, _EMPTY, np.uint64)
        np.minimum.at(table, at, hashed & np.uint64(_EMPTY))
        return table[:-1].reshape(len(lines), self.fine)

    def signatures(self, lines: list[str]):
        """(bands, sketches) of the lines."""
        import numpy as np

        fine = self.minima(lines)
        table = fine.reshape(len(lines), -1, self.bins).min(1)
        own = table.copy()
        row, column = np.nonzero(table == _EMPTY)
        for turn in range(self.bins - 1):
            if not len(row):
                break
            lent = own[row, self.lenders[column, turn]]
            table[row, column] = lent
            still = lent == _EMPTY
            row, column = row[still], column[still]
        mixed = (table.reshape(len(lines), BANDS, ROWS) * self.mixers).sum(2) + np.arange(BANDS, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        least = fine.reshape(len(lines), -1, BINS).min(1)
        return (mixed ^ (mixed >> np.uint64(31))).view(np.int64), packed(least, least != _EMPTY)


def _cut(text: str) -> list[str]:
    """The lines of a text in the form in which they are compared."""
    return [x.strip(" ") for x in text.replace("\t", " ").replace("\r", " ").lower().split("\n")]


def _hashes(lines: list[str]):
    """The names of lines."""
    import numpy as np
    import xxhash

    of = xxhash.xxh3_64_intdigest
    return (np.array([of(x.encode("utf-8", "replace")) for x in lines], np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _signed(batches: Iterator, shingle: int) -> Iterator:
    """(doc, hash of the text, text) to (doc, hash, id, pos, bands, sketch, n_lines, blank).

    Each line comes once a batch, where it comes first; a row without ``id`` tells of each
    text how many lines it has and which are blank.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    signer = Signer(shingle)
    names = ["doc", "thash", "id", "pos", "bands", "sketch", "n_lines", "blank"]

    def lines_out(batch, lines: list[str], rows, ids, pos):
        bands, sketches = signer.signatures(lines)
        rows, n = pa.array(rows), len(lines)
        columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ids), pa.array(pos, pa.int32()), packed_rows(bands), packed_rows(sketches)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names)

    for batch in batches:
        order = pc.sort_indices(batch, [("doc", "ascending"), ("thash", "ascending")], null_placement="at_start")
        batch = batch.take(order)
        seen: set[int] = set()
        counts, blanks = [], []
        for at in range(0, batch.num_rows, 512):
            cuts = [_cut(text) if text is not None else [] for text in batch.column(2).slice(at, 512).to_pylist()]
            sizes = np.array([len(x) for x in cuts], np.int64)
            counts += sizes.tolist()
            blanks += [[pos for pos, line in enumerate(cut) if not line] for cut in cuts]
            rows = np.repeat(np.arange(len(cuts)), sizes)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lines = [line for cut in cuts for line in cut]
            ids = _hashes(lines)
            kept = [i for i, x in enumerate(ids.tolist()) if lines[i] and x not in seen and not seen.add(x)]
            lines = [lines[i] for i in kept]
            rows, places, ids = (x[kept] for x in (rows + at, places, ids))
            chunk = np.cumsum([len(x) + shingle for x in lines]) // CHUNK
            ends = [0, *(np.nonzero(chunk[1:] != chunk[:-1])[0] + 1).tolist(), len(lines)]
            for a, b in zip(ends, ends[1:], strict=False):
                if b > a:
                    yield lines_out(batch, lines[a:b], rows[a:b], ids[a:b], places[a:b])
        n = batch.num_rows
        nothing = [pa.nulls(n, x) for x in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *nothing, pa.array(counts, pa.int64()), pa.array(blanks, pa.list_(pa.int32()))], names)


def _picked(batches: Iterator, wanted: Sieve) -> Iterator:
    """(text) to (id, line) of the lines that may be wanted, each once a batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        seen: set[int] = set()
        for at in range(0, batch.num_rows, 512):
            lines = [line for text in batch.column(0).slice(at, 512).to_pylist() if text for line in _cut(text) if line]
            ids = _hashes(lines)
            passed = np.nonzero(wanted(ids.view(np.uint64)))[0]
            keep = [i for i, x in zip(passed.tolist(), ids[passed].tolist(), strict=True) if x not in seen and not seen.add(x)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([lines[i] for i in keep], pa.string())], ["id", "line"])


def shingles(line: str, k: int = SHINGLE) -> Hashes:
    """The set of ``k``-character runs of a line; a shorter line is one run."""
    import numpy as np

    codes = np.frombuffer((line + "\0" * (k - len(line))).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return Hashes.of(_runs(codes, k))


def all_shingles(lines: list[str], k: int = SHINGLE):
    """(place of the line, hash) of the shingles of many lines, as ``shingles`` has them; repeats are kept."""
    import numpy as np

    codes = np.frombuffer("".join([x + "\0" * (k - len(x)) for x in lines]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([max(k, len(x)) for x in lines], np.int64)
    count = sizes - k + 1
    place = np.repeat(np.arange(len(lines)), count)
    return place, _runs(codes, k)[np.arange(len(place)) + place * (k - 1)]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("thash"), text.alias("text"))


def _signatures(slim: DataFrame, shingle: int) -> DataFrame:
    kind = slim.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, thash long, id long, pos int, bands binary, sketch binary, n_lines long, blank array<int>"
    # random bytes make no dictionary
    plain = {f"parquet.enable.dictionary#{x}": "false" for x in ("id", "bands", "sketch")}
    return stored(slim.mapInArrow(lambda it: _signed(it, shingle), schema), **plain)


def components(slim: DataFrame, signed: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, first) of every different line of (doc, thash, text), and (node, root) of the lines with near-copies."""
    lines = signed.where("id is not null")
    # a line that comes in several batches is there as often, which only these two tables have to mind
    firsts = stored(lines.repartition("id").groupBy("id").agg(F.min(F.struct("doc", "thash", "pos")).alias("first")))

    def sketches(ids: DataFrame) -> DataFrame:
        return sieved(lines.select("id", "sketch"), "id", ids).repartition("id").groupBy("id").agg(F.first("sketch").alias("sketch"))

    def texts(ids: DataFrame) -> DataFrame:
        shared = slim.sparkSession.sparkContext.broadcast(sieve(ids))
        rows = slim.select("text").mapInArrow(lambda it: _picked(it, shared.value), "id long, line string")
        return rows.repartition("id").groupBy("id").agg(F.first("line").alias("line"))

    members = grouped(lines.select("id", "bands"), BANDS)
    return firsts, linked(members, sketches, texts, lambda x: shingles(x, shingle), similarity, BLOCK, cuts=lambda x: all_shingles(x, shingle))


def _kept(slim: DataFrame, signed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (doc, thash, places): where the lines that stay come first."""
    firsts, roots = components(slim, signed, shingle, similarity)
    everyone = settle(roots.unionByName(roots.select("root", "root").distinct().toDF("node", "root")))
    # of each component the first place stays; its lines are told by their ids alone, so none is joined by component
    best = everyone.join(firsts, F.col("node") == F.col("id")).groupBy("root").agg(F.min("first").alias("first"))
    alone = firsts.join(everyone, F.col("node") == F.col("id"), "left_anti")
    stay = alone.select("first.*").unionByName(best.select("first.*"))
    return stay.groupBy("doc", "thash").agg(F.collect_list("pos").alias("places"))


def _with_places(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Add ``places`` to rows (doc, thash, ...): of rows that are alike, one gets the places."""
    from pyspark.sql import Window as W

    same = rows["doc"].eqNullSafe(kept["doc"]) & (rows["thash"] == kept["thash"])
    joined = rows.join(kept, same, "left").select(rows["*"], "places")
    nth = F.row_number().over(W.partitionBy("doc", "thash").orderBy("thash"))
    places = F.when(nth == 1, F.col("places"))
    return joined.withColumn("places", F.coalesce(places, F.array().cast("array<int>")))


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Rows (id, n_lines, kept) for every row of ``docs``: the places of the lines to keep.

    Lines are cut at line feeds, trimmed and lower-cased.  Lines that are equal, or whose
    sets of ``shingle``-character runs have a Jaccard similarity of at least ``similarity``
    with each other or through others, form a component, and only its first line stays: the
    one with the smallest id (null first), then hash of the text, then place.  Lines shorter
    than a shingle are one shingle.  Blank lines are always kept.  ``kept`` lists places from
    0, ascending.  Null texts have no lines, an empty text has one blank line.  Of rows with
    equal ids and texts one keeps its lines, so repeated rows count as several documents.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    slim = _slim(docs, id_col, text_col)
    signed = _signatures(slim, shingle)
    rows = signed.where("id is null").select("doc", "thash", "n_lines", "blank")
    placed = _with_places(rows, _kept(slim, signed, shingle, similarity))
    return placed.select(F.col("doc").alias("id"), "n_lines", F.array_sort(F.concat("blank", "places")).alias("kept"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with repeated lines removed from the text; other columns, of any names, are passed on."""
    slim = _slim(docs, id_col, text_col)
    kept = _kept(slim, _signatures(slim, shingle), shingle, similarity)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("thash"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))
    cut = F.split("text", "\n")
    blank = F.array_compact(F.transform(cut, lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) == "", i)))
    stay = F.array_sort(F.concat(F.coalesce(blank, F.array().cast("array<int>")), "places"))
    clean = _with_places(rows, kept).withColumn("clean", F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))
    out = [F.when(F.col("text").isNotNull(), F.col("clean")).alias(c) if c == text_col else F.col("given")[c].alias(c) for c in docs.columns]
    return clean.select(*out)
