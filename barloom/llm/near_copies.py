"""Near copies of documents by SimHash with pivot distance tables, confirmed by exact Jaccard.

Texts are compared as sets of word shingles, held as 64-bit hashes.  Texts of equal sets form
one class, and only classes are compared.  A class has a wide SimHash of ``BLOCK_BITS`` bits a
block, so that a pair at the threshold agrees in no whole block with a chance of ``MISS`` at
most; a block's distances to its single-bit pivots are the block itself, which is the key.
Pairs that share a key and differ in few of the first ``HEAD`` bits are candidates.

Distances to ``PIVOTS`` reference fingerprints over all bits are computed once a class and
stored.  For each pivot two distances differ by the sum of as many random signs as there are
differing bits, so the mean square of these differences estimates that number, and candidates
with too large a mean are discarded.  Those left are tested on the whole fingerprints, and then
verified exactly as those of the line search are (``verify``).  All bounds lie five deviations
above what pairs at the threshold have.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import shuffle_width, sieved, stored
from barloom.llm.simhash import _words
from barloom.llm.verify import Hashes, _sorted_pairs, linked

SHINGLE, SIMILARITY, SEED = 5, 0.8, 37
#: Bits of a block, and the chance that a pair at the threshold agrees in no block.
BLOCK_BITS, MISS = 16, 0.001
#: Bits that all pairs of a key are compared by, and pivots of the stored table.
HEAD, PIVOTS = 128, 64
#: Shingles whose bits are counted at once: a byte holds the count.
PART = 255
#: Classes whose keys are packed at once, and that a part of a block's keys holds, about.
RUN, SHARE = 1 << 12, 1 << 18
#: Classes of a key from which on those near a common one are set aside first, and at most so many times.
CROWD, CENTRES = 256, 16
#: Texts of a band that are compared in one block.
BLOCK = 1024


def shingles(text: bytes | None, k: int = SHINGLE) -> Hashes:
    """The hashed runs of ``k`` words; fewer words are one shingle, no words none.

    Texts are lower-cased in A-Z and cut at space and U+0009 to U+000D.
    """
    import numpy as np
    import xxhash

    parts, tail, total = [], [], 0
    for words in _words(text or b""):
        words = tail + words
        runs = zip(*(words[i:] for i in range(k)), strict=False)
        parts.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs), np.uint64))
        total += len(parts[-1])
        tail = words[-(k - 1) :] if k > 1 else []
    if not total and tail:
        parts = [np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)]
    return Hashes.of(np.concatenate(parts) if parts else np.zeros(0, np.uint64))


class Signer:
    """Fingerprints and distance tables of shingle sets, and the tests on them; the same in every process."""

    def __init__(self, similarity: float) -> None:
        import numpy as np

        self.similarity = similarity
        # sets of one size at the threshold are the farthest apart: a bit differs by their angle
        flip = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        agree = (1 - flip) ** BLOCK_BITS
        blocks = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1
        #: whole longs, and the head at least
        self.longs = max(HEAD // 64, math.ceil(blocks * BLOCK_BITS / 64))
        self.bits, self.blocks = self.longs * 64, self.longs * 64 // BLOCK_BITS
        bound = lambda n: n * flip + 5 * math.sqrt(n * flip * (1 - flip))
        self.head, self.radius = bound(HEAD), bound(self.bits)
        most = self.bits * flip
        self.spread = most + 5 * math.sqrt(most**2 * 2 / PIVOTS + most * (1 - flip))
        rng = np.random.default_rng(SEED)
        self.factors, self.shifts = (rng.integers(1, 2**63, self.longs, dtype=np.uint64) for _ in range(2))
        self.factors = self.factors | np.uint64(1)
        #: a shingle that all sets have, so that the smallest ones do not tie
        self.common = rng.integers(0, 2, self.bits)
        self.pivots = rng.integers(0, 2, (self.bits, PIVOTS)).astype(np.float32) * 2 - 1

    def alone(self, hashes: Hashes) -> bool:
        """Whether the set is so small that no other one reaches the similarity."""
        return len(hashes) < self.similarity * (len(hashes) + 1)

    def fingerprint(self, hashes: Hashes) -> bytes:
        """The SimHash: a bit is set where more than half of the shingles have it."""
        import numpy as np

        counts = self.common.copy()
        for at in range(0, len(hashes), PART):
            mixed = hashes.values[at : at + PART, None] * self.factors + self.shifts
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
        return np.packbits(counts * 2 > len(hashes) + 1).tobytes()

    def distances(self, prints: list[bytes]):
        """The table's rows: distances to the pivots less half of the bits, a byte each."""
        import numpy as np

        out = np.zeros((len(prints), PIVOTS), np.int8)
        for at in range(0, len(prints), 256):
            octets = np.frombuffer(b"".join(prints[at : at + 256]), np.uint8).reshape(-1, self.bits // 8)
            signs = np.unpackbits(octets, axis=1).astype(np.float32) * 2 - 1
            out[at : at + 256] = np.clip(np.rint(signs @ self.pivots / -2), -127, 127)
        return out

    def discarded(self, a, b):
        """Whether the tables' rows of pairs are too far apart."""
        import numpy as np

        apart = a.view(np.int8).astype(np.int32) - b.view(np.int8)
        return (apart * apart).sum(1) > PIVOTS * self.spread

    def near(self, a, b):
        """Whether pairs of (distances, fingerprint) stay: by the distances first, then by all bits."""
        import numpy as np

        stay = ~self.discarded(a[:, :PIVOTS], b[:, :PIVOTS])
        stay[stay] = np.bitwise_count(a[stay, PIVOTS:] ^ b[stay, PIVOTS:]).sum(1, dtype=np.int32) <= self.radius
        return stay


@functools.cache
def _signer(similarity: float) -> Signer:
    return Signer(similarity)


def _signed(batches: Iterator, shingle: int, similarity: float) -> Iterator:
    """Arrow batches (row, doc, text) to (row, doc, digest of the shingle set, fingerprint, distances)."""
    import pyarrow as pa
    import xxhash

    signer = _signer(similarity)
    for batch in batches:
        digests, prints = [], []
        for at in range(0, batch.num_rows, 256):
            for text in batch.column(2).slice(at, 256).to_pylist():
                found = shingles(text, shingle)
                digests.append(xxhash.xxh3_128_digest(found.values.tobytes()))
                prints.append(None if signer.alone(found) else signer.fingerprint(found))
        far = iter(signer.distances([x for x in prints if x]))
        tables = [next(far).tobytes() if x else None for x in prints]
        columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (digests, prints, tables))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc", "digest", "print", "far"])


# --- candidates ---------------------------------------------------------------------------

#: A class under one of its keys: the key, the class, the first bits.
_RECORD = [("key", "<u2"), ("id", "<i8"), ("head", "<u8", (HEAD // 64,))]


def _packed_keys(batches: Iterator, bits: int) -> Iterator:
    """(id, fingerprint) to (part, records): a part is a block and the first ``bits`` bits of its keys."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            some = batch.slice(at, RUN)
            prints = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1)
            records = np.zeros(some.num_rows, _RECORD)
            records["id"], records["head"] = some.column(0).to_numpy(), prints[:, : HEAD // 8].copy().view("<u8")
            parts, blobs = [], []
            for block, keys in enumerate(prints.view("<u2").T):
                order = np.argsort(keys, kind="stable")
                records["key"] = keys
                laid, shares = records[order], keys[order] >> (BLOCK_BITS - bits) if bits else np.zeros(len(order), np.uint16)
                start = np.nonzero(np.append(True, shares[1:] != shares[:-1]))[0].tolist()
                parts += [(block << bits) + int(shares[x]) for x in start]
                blobs += [laid[a:b].tobytes() for a, b in zip(start, [*start[1:], len(laid)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "records"])


def _unite(label, left, right) -> None:
    """Give the rows of pairs one label, their smallest row."""
    import numpy as np

    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while len(left) and not np.array_equal(up := label[label], label):
            label[:] = up


def clusters(records, radius: float, most: int = 1 << 18):
    """(records, labels): rows of one key that are within the radius, or are so through others, get one label."""
    import numpy as np

    records = records[np.argsort(records["key"], kind="stable")]
    key, head = records["key"], records["head"]
    near = lambda x, y: np.bitwise_count(head[x] ^ head[y]).sum(-1, dtype=np.int32) <= radius
    start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
    size = np.diff(np.append(start, len(key)))
    order, label, after = np.arange(len(key)), np.arange(len(key)), np.arange(1, len(key) + 1)
    for first, n in zip(start[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
        left, groups = np.arange(first, first + n), []
        while len(left) > CROWD and len(groups) < CENTRES:
            close = near(left, left[0])
            groups.append(left[close])
            left = left[~close]
        order[first : first + n] = np.concatenate([*groups, left])
        for group in groups:  # rows of one group are compared with those behind it only
            label[first : first + len(group)] = first
            first += len(group)
            after[first - len(group) : first] = first
    records = records[order]
    head = records["head"]
    partners = np.repeat(start + size, size) - after
    sums, at = np.cumsum(partners), 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        own = partners[at:end]
        left = np.repeat(np.arange(at, end), own)
        right = np.repeat(after[at:end], own) + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        met = near(left, right)
        _unite(label, left[met], right[met])
        at = end
    return records, label


def _met(batches: Iterator, radius: float, bits: int) -> Iterator:
    """Rows of ``_packed_keys`` by part to the (band, id, centre, open) of keys with several near classes."""
    import numpy as np
    import pyarrow as pa

    def of_part(part: int, blobs: list[bytes]):
        records, label = clusters(np.frombuffer(b"".join(blobs), _RECORD), radius)
        several = np.bincount(label)[label] > 1
        ids, first = records["id"][several], records["id"][label[several]]
        place = (part >> bits << BLOCK_BITS) + records["key"][several].astype(np.uint64)
        band = (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ first.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        band = ((band ^ (band >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)
        bands, ids, start, size = _sorted_pairs(band, ids)
        columns = [bands, ids, np.repeat(ids[start], size), np.repeat(size > 2, size)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["band", "id", "centre", "open"])

    part, blobs = None, []
    for batch in batches:
        for now, records in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now != part and blobs:
                yield of_part(part, blobs)
                blobs = []
            part = now
            blobs.append(records.as_py())
    if blobs:
        yield of_part(part, blobs)


def candidates(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (band, id, centre, open) of the (id, fingerprint) that share a key with near ones; see ``verify.grouped``."""
    width, radius = shuffle_width(prints.sparkSession), _signer(similarity).head
    bits = min(BLOCK_BITS, max(0, math.ceil(math.log2(max(1, prints.count()) / SHARE))))
    dealt = prints.mapInArrow(lambda it: _packed_keys(it, bits), "part int, records binary")
    laid = dealt.repartition(width, "part").sortWithinPartitions("part")
    return stored(laid.mapInArrow(lambda it: _met(it, radius, bits), "band long, id long, centre long, open boolean"))


def near_copies(
    docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Rows (row, first) for every row of ``docs``: the row to keep of its group of near copies.

    Texts whose sets of ``shingle``-word runs have a Jaccard similarity of at least
    ``similarity`` with each other or through others form a group, and its first row is the
    one with the smallest id (null first), then row.  ``row_col`` is a stored column of
    distinct longs.  Texts without words, null ones too, are copies of each other.
    """
    slim = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()
    signed = stored(slim.mapInArrow(lambda it: _signed(it, shingle, similarity), f"row long, doc {kind}, digest binary, print binary, far binary"))
    least = F.min(F.struct("doc", "row", "print", "far")).alias("least")
    classes = stored(signed.groupBy("digest").agg(least).select("digest", F.col("least.row").alias("id"), "least"))

    def texts(ids: DataFrame) -> DataFrame:
        keyed = slim.select("row", "text", F.xxhash64("row").alias("key"))
        return sieved(keyed, "key", ids.select(F.xxhash64("id").alias("key"))).select(F.col("row").alias("id"), F.col("text").alias("line"))

    members = candidates(classes.where("least.print is not null").select("id", "least.print"), similarity)
    sketches = classes.select("id", F.concat("least.far", "least.print").alias("sketch"))
    roots = linked(
        members, lambda ids: sketches.join(ids, "id", "left_semi"), texts, lambda x: shingles(x, shingle), similarity, BLOCK, lambda a, b: _signer(similarity).near(a, b)
    )

    named = classes.join(roots, F.col("id") == F.col("node"), "left").select(
        "digest", F.coalesce("root", "id").alias("root"), F.struct("least.doc", "least.row").alias("least")
    )
    names = named.groupBy("root").agg(F.min("least").alias("first"))
    labels = named.join(names, "root").select("digest", F.col("first.row").alias("first"))
    return signed.select("row", "digest").join(labels, "digest").select("row", "first")
