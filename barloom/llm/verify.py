"""Verification of candidates that share a band, and their links.

(id, band) pairs are packed into blocks of bytes, one a target part, so the shuffle moves 16
bytes a pair.  Bands that many texts of a run share get a centre in that run, and only two of them
go on to the shuffle, so a band of any size is spread over the tasks.  All others of a band
meet in its part, and the first in a hashed order is their centre.

Each text is compared with its centres.  Sketches of the shingle sets sort out most pairs
without their texts; those left are verified exactly.  Only where a band then still holds
several components are its other pairs compared, in blocks, first by the sketches and then by
the texts, and never two texts of one component.  Sketches and texts are joined to ids, a row each
with the list of its bands or centres, and then packed for the parts in which their blocks meet.  Components come from a distributed union of
the links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Sieve, settle, shuffle_width, sieve, stored
from barloom.llm.components import connected_components

#: Texts of a run that share a band, from which on they get a centre in the run.
CROWD = 8
#: Pairs that are packed at once, and that a part holds, about.
RUN, PART = 1 << 19, 1 << 20
#: Bins of a sketch, half a byte each.
BINS = 160
#: Ids whose places are packed at once, places and rows with texts that a part holds, about, and pairs that are compared at once.
SLICE, SPAN, TEXTS, CHUNK = 1 << 10, 1 << 16, 1 << 11, 1 << 16
#: Pairs whose shingles are sorted at once (their number fits a byte), and characters of them, about.
PAIRS, LETTERS = 256, 1 << 18
#: Pairs of a centre from which on it goes to several blocks.
CROWDED = 1 << 14


class Hashes:
    """A set of 64-bit hashes as a sorted array."""

    def __init__(self, values) -> None:
        self.values = values

    @classmethod
    def of(cls, values) -> Hashes:
        import numpy as np

        values = np.sort(values)
        return cls(values[np.append(True, values[1:] != values[:-1])[: len(values)]])

    def __len__(self) -> int:
        return len(self.values)


def may_reach(a: int, b: int, similarity: float) -> bool:
    """Whether sets of these sizes can have that similarity."""
    return min(a, b) >= similarity * max(a, b) * (1 - 1e-9)


def jaccard(a: Hashes, b: Hashes) -> float:
    import numpy as np

    every = np.concatenate((a.values, b.values))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both / max(1, len(every) - both)


# --- sketches -----------------------------------------------------------------------------


def packed(minima, filled):
    """Sketches of half a byte a bin from its smallest hash: 0 for an empty bin, else 1 to 15."""
    import numpy as np

    if minima.max(initial=0) < 1 << 32:
        minima = minima.astype(np.uint32)  # divided faster
    halves = (minima % 15 + 1).astype(np.uint8) * filled
    return halves[:, ::2] | halves[:, 1::2] << 4


@functools.cache
def _halves():
    """For each byte, how many of its halves are zero."""
    import numpy as np

    octets = np.arange(256)
    return ((octets & 15 == 0).astype(np.uint8) + (octets >> 4 == 0)).astype(np.uint8)


def alike(a, b, similarity: float):
    """Whether pairs of sketches agree in as many bins as all but about 2 in a million pairs of that similarity."""
    import numpy as np

    empty = _halves()[a | b].sum(-1, dtype=np.int32)
    agree, used = _halves()[a ^ b].sum(-1, dtype=np.int32) - empty, BINS - empty
    rate = similarity + (1 - similarity) / 15
    return agree >= np.floor(used * rate - 4.6 * np.sqrt(used * rate * (1 - rate)))


def packed_rows(table):
    """A binary column of the bytes of each row of a table of numbers."""
    import numpy as np
    import pyarrow as pa

    ends = np.arange(len(table) + 1, dtype=np.int32) * np.int32(table[:1].nbytes)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table))])


def octets(column):
    """The bytes of a binary column without nulls, one value after the other."""
    import numpy as np
    import pyarrow as pa

    if not len(column):
        return np.zeros(0, np.uint8)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[1]]


def _sketches(column):
    return octets(column).reshape(len(column), -1 if len(column) else 0)


# --- bands --------------------------------------------------------------------------------


def _sorted_pairs(bands, ids):
    """Different (band, id) by band, in an order of ids that each band shuffles anew, and the first of each band."""
    import numpy as np

    order = np.argsort(bands)
    bands, ids = bands[order], ids[order]
    # most bands have one id; only the ids of the others are sorted
    same = bands[1:] == bands[:-1]
    several = np.nonzero(np.append(same, False)[: len(bands)] | np.append(False, same)[: len(bands)])[0]
    ids[several] = ids[several][np.lexsort((ids[several] ^ bands[several], bands[several]))]
    new = np.append(True, (bands[1:] != bands[:-1]) | (ids[1:] != ids[:-1]))[: len(bands)]
    bands, ids = bands[new], ids[new]
    start = np.nonzero(np.append(True, bands[1:] != bands[:-1])[: len(bands)])[0]
    return bands, ids, start, np.diff(np.append(start, len(bands)))


def _packed_pairs(batches: Iterator, parts: int) -> Iterator:
    """(id, bands) to (part, crowd, pairs); pairs of a crowd come with their centre."""
    import numpy as np
    import pyarrow as pa

    def rows(part, columns, crowd: bool) -> list[dict]:
        if not len(part):
            return []
        table = np.stack(columns, 1)
        if crowd:
            order = np.argsort(part, kind="stable")
            part, table = part[order], table[order]
        start = np.nonzero(np.append(True, part[1:] != part[:-1])[: len(part)])[0].tolist()
        return [{"part": int(part[a]), "crowd": crowd, "pairs": table[a:b].tobytes()} for a, b in zip(start, [*start[1:], len(part)], strict=True)]

    def flush(bands, ids) -> list[dict]:
        bands, ids, start, size = _sorted_pairs(np.concatenate(bands), np.concatenate(ids))
        crowded = np.repeat(size >= CROWD, size)
        centre = np.repeat(ids[start], size)
        # two of a crowd go on, so that their band counts as open wherever a third text meets them
        stay = ~crowded
        stay[start] = stay[start[size > 1] + 1] = True
        on = bands[stay]
        # ranges of bands, which are sorted, make the parts
        out = rows(((on.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), [on, ids[stay]], False)
        spread = (ids[crowded].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(parts)
        return out + rows(spread.astype(np.int64), [bands[crowded], ids[crowded], centre[crowded]], True)

    schema = pa.schema([("part", pa.int32()), ("crowd", pa.bool_()), ("pairs", pa.binary())])
    bands, ids, held = [], [], 0
    for batch in batches:
        lists = batch.column(1)
        if pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type):
            bands.append(lists.flatten().to_numpy())
            size = lists.value_lengths().to_numpy()
        else:
            bands.append(octets(lists).view(np.int64))
            size = len(bands[-1]) // max(1, len(lists))
        ids.append(np.repeat(batch.column(0).to_numpy(), size))
        held += len(bands[-1])
        if held >= RUN:
            yield pa.RecordBatch.from_pylist(flush(bands, ids), schema=schema)
            bands, ids, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_pylist(flush(bands, ids), schema=schema)


def _met(batches: Iterator) -> Iterator:
    """Rows of ``_packed_pairs`` by part to the (band, id, centre, open) of bands with several ids."""
    import numpy as np
    import pyarrow as pa

    def out(bands, ids, centre, size=None):
        several = pa.array([True] * len(ids) if size is None else size > 2, pa.bool_())
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (bands, ids, centre)], several], ["band", "id", "centre", "open"])

    def of_part(blobs: list[bytes]):
        table = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        bands, ids, start, size = _sorted_pairs(table[:, 0], table[:, 1])
        several = np.repeat(size > 1, size)
        centre = np.repeat(ids[start], size)
        return out(bands[several], ids[several], centre[several], np.repeat(size, size)[several])

    part, blobs = None, []
    for batch in batches:
        for now, crowd, pairs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if crowd:
                yield out(*np.frombuffer(pairs, np.int64).reshape(-1, 3).T.copy())
                continue
            if now != part and blobs:
                yield of_part(blobs)
                blobs = []
            part = now
            blobs.append(pairs)
    if blobs:
        yield of_part(blobs)


def grouped(signed: DataFrame, per_id: int) -> DataFrame:
    """Rows (band, id, centre, open) of the (id, bands) that share a band with other ids; repeated rows are harmless.

    ``bands`` is an array of longs, or ``per_id`` of them packed in bytes.  Only a band that is ``open`` may have pairs without its centre.
    """
    width = shuffle_width(signed.sparkSession)
    parts = max(width, math.ceil(signed.count() * per_id / PART))
    dealt = signed.mapInArrow(lambda it: _packed_pairs(it, parts), "part int, crowd boolean, pairs binary")
    laid = dealt.repartition(width, "part").sortWithinPartitions("part")
    return stored(laid.mapInArrow(_met, "band long, id long, centre long, open boolean"))


# --- pairs --------------------------------------------------------------------------------


#: A row in a block: the block, its side of it, the row and its component.
_PLACE = [("band", "<i8"), ("low", "<i4"), ("high", "<i4"), ("side", "<i4"), ("id", "<i8"), ("root", "<i8")]


def _mixed(values):
    import numpy as np

    values = (values.view(np.uint64) ^ values.view(np.uint64) >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ values >> np.uint64(32)


def _packed_rows(places, row, sketch, parts: int):
    """(part, places, sketches): the places, and the sketches of their rows, packed by the part that their blocks go to."""
    import numpy as np
    import pyarrow as pa

    tile = places["band"] + (places["low"].astype(np.int64) << 32) + places["high"]
    part = (_mixed(tile) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, places, row = part[order], places[order], row[order]
    start = np.nonzero(np.append(True, part[1:] != part[:-1])[: len(part)])[0].tolist()
    ends = list(zip(start, [*start[1:], len(part)][: len(start)], strict=True))
    columns = [pa.array(part[start]), *(pa.array(x, pa.binary()) for x in ([places[a:b].tobytes() for a, b in ends], [sketch[row[a:b]].tobytes() for a, b in ends]))]
    return pa.RecordBatch.from_arrays(columns, ["part", "places", "sketches"])


_PACKED = "part int, places binary, sketches binary"


def _parts(batches: Iterator) -> Iterator:
    """Rows of ``_packed_rows`` by part to the (places, sketches) of each part, sorted by block and id."""
    import numpy as np

    def whole(held: list):
        places = np.frombuffer(b"".join(x for x, _ in held), _PLACE)
        sketch = np.frombuffer(b"".join(x for _, x in held), np.uint8).reshape(len(places), -1)
        order = np.lexsort([places[x] for x in ("id", "high", "low", "band")])
        return places[order], sketch[order]

    part, held = None, []
    for batch in batches:
        for now, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if now != part and held:
                yield whole(held)
                held = []
            part = now
            held.append(row)
    if held:
        yield whole(held)


def _starts(places):
    """The first row of each block."""
    import numpy as np

    new = np.any([places[x][1:] != places[x][:-1] for x in ("band", "low", "high")], 0)
    return np.nonzero(np.append(True, new)[: len(places)])[0]


def _by_id(batches: Iterator) -> Iterator:
    """(id, centre, band, open), sorted by id, to a row of each id with its different centres and open bands."""
    import numpy as np
    import pyarrow as pa

    def lists(of, values, n: int):
        """The different values of each of ``n`` ids."""
        order = np.lexsort((values, of))
        of, values = of[order], values[order]
        new = np.append(True, (of[1:] != of[:-1]) | (values[1:] != values[:-1]))[: len(of)]
        return pa.ListArray.from_arrays(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32), pa.array(values[new]))

    for rows, start in whole_blocks(batches, ("id",)):
        ids, centres, bands = (rows.column(x).to_numpy() for x in range(3))
        open_ = rows.column(3).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[start]), lists(of, centres, len(start)), lists(of[open_], bands[open_], len(start))], ["id", "centres", "bands"])


def _wheels(batches: Iterator, parts: int, crowded: dict[int, int]) -> Iterator:
    """(id, centres, sketch) to ``_packed_rows``: blocks of a centre (as band) and rows to compare with it; of a crowded centre several."""
    import numpy as np

    names = np.array(sorted(crowded), np.int64)
    shares = np.array([crowded[x] for x in names.tolist()] or [1], np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            ids, lists = some.column(0).to_numpy(), some.column(1)
            row, centre = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            found = np.minimum(np.searchsorted(names, centre), len(shares) - 1)
            share = np.where(np.isin(centre, names), shares[found], 1)
            copies = np.where(ids[row] == centre, share, 1)  # the centre goes to all its blocks
            turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, centre, share = (np.repeat(x, copies) for x in (row, centre, share))
            places = np.zeros(len(row), _PLACE)
            places["band"], places["id"] = centre, ids[row]
            places["low"] = np.where(ids[row] == centre, turn, _mixed(ids[row]) % share.astype(np.uint64))
            yield _packed_rows(places, row, _sketches(some.column(2)), parts)


def _sorted_out(batches: Iterator, near: Callable) -> Iterator:
    """Rows of ``_wheels`` by part to the pairs (a, b) of a row and its centre whose sketches are alike."""
    import numpy as np
    import pyarrow as pa

    for places, sketch in _parts(batches):
        start = _starts(places)
        size = np.diff(np.append(start, len(places)))
        spoke = places["id"] != places["band"]
        hub = np.zeros(len(start), np.int64)
        hub[np.repeat(np.arange(len(start)), size)[~spoke]] = np.nonzero(~spoke)[0]
        left, right = np.nonzero(spoke)[0], np.repeat(hub, size)[spoke]
        for at in range(0, len(left), CHUNK):
            a, b = left[at : at + CHUNK], right[at : at + CHUNK]
            keep = near(sketch[a], sketch[b])
            yield pa.RecordBatch.from_arrays([pa.array(places["id"][x[keep]]) for x in (a, b)], ["a", "b"])


def similar(left: list, right: list, cuts: Callable, similarity: float):
    """Whether pairs of texts are similar enough; ``cuts`` gives (place in a list of texts, hash) of all their shingles.

    The shingles of up to ``PAIRS`` pairs are sorted at once, by the pair, 55 bits of the hash and the side.
    """
    import numpy as np

    ends = np.cumsum([len(x) + len(y) for x, y in zip(left, right, strict=True)])
    keep, at = np.zeros(len(left), bool), 0
    while at < len(left):
        end = min(at + PAIRS, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right"))))
        sides = []
        for side, texts in enumerate((left[at:end], right[at:end])):
            place, keys = cuts(texts)
            keys >>= np.uint64(9)
            keys <<= np.uint64(1)
            keys |= place.view(np.uint64) << np.uint64(56)
            keys |= np.uint64(side)
            sides.append(keys)
        every = np.concatenate(sides)
        every.sort()
        every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
        pairs = np.arange(end - at, dtype=np.uint64) << np.uint64(56)
        count = lambda x: np.diff(np.append(np.searchsorted(x, pairs), len(x)))  # noqa: B023, E731
        both = count(every[1:][every[1:] ^ every[:-1] == 1])
        keep[at:end] = both / np.maximum(1, count(every) - both) >= similarity
        at = end
    return keep


def _verified(batches: Iterator, cut: Callable, similarity: float, cuts: Callable | None) -> Iterator:
    """(a, b, left, right) to the (a, b) whose texts are similar enough."""
    import pyarrow as pa

    known = functools.lru_cache(32)(cut)  # rows of one centre come together
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        if cuts:
            keep = similar(left, right, cuts, similarity)
        else:
            keep = [jaccard(cut(x), known(y)) >= similarity for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def whole_blocks(batches: Iterator, keys: tuple[str, ...] = ("band", "low", "high")) -> Iterator:
    """(rows, starts): rows that come sorted by the keys, cut so that every block is whole."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = [batch.column(x).to_numpy() for x in keys]
        start = np.nonzero(np.append(True, np.any([x[1:] != x[:-1] for x in key], 0)))[0]
        held = batch.slice(int(start[-1]))
        if len(start) > 1:
            yield batch.slice(0, int(start[-1])), start[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def pairs_within(starts, rows: int, most: int = 1 << 18) -> Iterator:
    """All pairs (left, right) of rows of one block, about ``most`` at once."""
    import numpy as np

    size = np.diff(np.append(starts, rows))
    count = np.repeat(starts + size, size) - np.arange(rows) - 1
    sums = np.cumsum(count)
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        own = count[at:end]
        left = np.repeat(np.arange(at, end), own)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        at = end


def _near(places, root, sketch, starts, near: Callable) -> Iterator:
    """Pairs of rows of one block that may be linked: other components, alike sketches, not dealt with in another block."""
    side, low, high = (places[x] for x in ("side", "low", "high"))
    for left, right in pairs_within(starts, len(places), (1 << 22) // max(64, sketch.shape[1])):
        open_ = (root[left] != root[right]) & ((low[left] == high[left]) | (side[left] != side[right]))
        left, right = left[open_], right[open_]
        keep = near(sketch[left], sketch[right])
        yield left[keep], right[keep]


def _laid_out(batches: Iterator, parts: int, wanted: Sieve, large: dict) -> Iterator:
    """(id, root, bands, sketch) to ``_packed_rows`` of the wanted bands; ``large`` has the (main, inside, outside) of those of many blocks, or None."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            ids, roots, lists = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2)
            row, band = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            many = np.isin(band, np.fromiter(large, np.int64, len(large)))
            once = ~many & wanted(band.view(np.uint64))
            tiles = []  # (place in the lists, side, other side)
            for i in np.nonzero(many)[0].tolist():
                if (of := large[int(band[i])]) is None:
                    continue
                main, inside, outside = of
                inner, spread = roots[row[i]] == main, int(_mixed(ids[row[i : i + 1]] ^ band[i])[0])
                side = spread % inside if inner else inside + spread % outside
                # blocks of the main component come first; two of them are never compared
                tiles += [(i, side, other) for other in range(inside if inner else 0, inside + outside)]
            tiled = np.array(tiles, np.int64).reshape(-1, 3)
            where = np.concatenate([np.nonzero(once)[0], tiled[:, 0]])
            places = np.zeros(len(where), _PLACE)
            row = row[where]
            places["band"], places["id"], places["root"] = band[where], ids[row], roots[row]
            more = places[len(where) - len(tiled) :]
            more["side"], more["low"], more["high"] = tiled[:, 1], tiled[:, 1:].min(1), tiled[:, 1:].max(1)
            yield _packed_rows(places, row, _sketches(some.column(3)), parts)


def _involved(batches: Iterator, near: Callable) -> Iterator:
    """The rows of ``_PLACE`` that have such a pair."""
    import numpy as np
    import pyarrow as pa

    for places, sketch in _parts(batches):
        used = np.zeros(len(places), bool)
        for left, right in _near(places, places["root"], sketch, _starts(places), near):
            used[left] = used[right] = True
        yield pa.RecordBatch.from_arrays([pa.array(places[x][used]) for x, _ in _PLACE], [x for x, _ in _PLACE])


def _texts_by_part(batches: Iterator, parts: int) -> Iterator:
    """(id, root, sketch, line, places) to (part, places, id, root, sketch, line): each part gets a text once."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            lists = some.column(4)
            flat = lists.flatten()
            row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
            places = np.zeros(len(row), _PLACE)
            for name, values in zip(("band", "low", "high", "side"), flat.flatten(), strict=True):
                places[name] = values.to_numpy()
            places["id"], places["root"] = some.column(0).to_numpy()[row], some.column(1).to_numpy()[row]
            part = (_mixed(places["band"] + (places["low"].astype(np.int64) << 32) + places["high"]) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((row, part))
            part, row, places = part[order], row[order], places[order]
            start = np.nonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1]))[: len(part)])[0]
            ends = zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True)
            blobs = pa.array([places[a:b].tobytes() for a, b in ends], pa.binary())
            taken = [some.column(i).take(pa.array(row[start])) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(part[start]), blobs, *taken], ["part", "places", "id", "root", "sketch", "line"])


def _sets(texts: list, cuts: Callable) -> list[Hashes]:
    """The sets of shingles of texts that ``cuts`` gives (see ``similar``), of 56 bits a hash."""
    import numpy as np

    ends, at, found = np.cumsum([len(x) for x in texts]), 0, []
    while at < len(texts):
        end = min(at + PAIRS, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right"))))
        place, hashed = cuts(texts[at:end])
        keys = np.sort(place.astype(np.uint64) << np.uint64(56) | hashed >> np.uint64(8))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        starts = np.searchsorted(keys, np.arange(1, end - at, dtype=np.uint64) << np.uint64(56))
        found += [Hashes(x) for x in np.split(keys & np.uint64((1 << 56) - 1), starts)]
        at = end
    return found


def _joined(batches: Iterator, cut: Callable, similarity: float, near: Callable, cuts: Callable | None = None) -> Iterator:
    """Rows of ``_texts_by_part`` by part to links between components of a block, at most one for each two that get joined."""
    import numpy as np
    import pyarrow as pa

    def of_part(held: list[tuple]):
        places = np.frombuffer(b"".join([x[0] for x in held]), _PLACE)
        row = np.repeat(np.arange(len(held)), [len(x[0]) // places.itemsize for x in held])
        order = np.lexsort([places[x] for x in ("id", "high", "low", "band")])
        places, row = places[order], row[order]
        ids, lines = [x[1] for x in held], [x[4] for x in held]
        sketch = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), -1)[row]
        parent: dict[int, int] = {}
        sets: dict[int, Hashes] = {}
        links: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for left, right in _near(places, places["root"], sketch, _starts(places), near):
            met = np.unique(row[left] * len(held) + row[right])  # texts may meet in several blocks
            first, second = met // len(held), met % len(held)
            if cuts:
                new = [x for x in np.unique(np.append(first, second)).tolist() if x not in sets]
                sets.update(zip(new, _sets([lines[x] for x in new], cuts), strict=True))
            for i, j in zip(first.tolist(), second.tolist(), strict=True):
                a, b = find(held[i][2]), find(held[j][2])
                if a == b:
                    continue
                for x in (i, j):
                    if x not in sets:
                        sets[x] = cut(lines[x])
                if may_reach(len(sets[i]), len(sets[j]), similarity) and jaccard(sets[i], sets[j]) >= similarity:
                    parent[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        columns = list(zip(*links, strict=True)) if links else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])

    part, held = None, []
    for batch in batches:
        for now, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if now != part and held:
                yield of_part(held)
                held = []
            part = now
            held.append(row)
    if held:
        yield of_part(held)


def _open_bands(opens: DataFrame, block: int) -> tuple[Sieve, dict, int]:
    """Which bands of (id, root, bands) still hold several components, how those of many texts are cut, and the rows of all.

    Bands of over ``block`` texts are listed: they are fewer than the rows by that factor.
    """
    labelled = opens.select("id", "root", F.explode("bands").alias("band"))
    by_root = labelled.groupBy("band", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("of"))
    bands = stored(by_root.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("inner"), F.bit_xor("of").alias("of")))
    # bands of the same texts are compared once
    once = stored(bands.where("roots > 1 and n > 2").groupBy("of", "n", "inner").agg(F.min("band").alias("band")))
    large = {x: None for x, _ in _listed(bands.where(F.col("n") > block).select("band", "n"))}
    if large:
        sizes = (F.ceil(F.col("inner") / block).cast("int"), F.ceil((F.col("n") - F.col("inner")) / block).cast("int"))
        split = once.where(F.col("n") > block).select("band", *(x.alias(name) for x, name in zip(sizes, ("inside", "outside"), strict=True)))
        main = by_root.join(split, "band").groupBy("band", "inside", "outside").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        large |= {x: tuple(of) for x, *of in _listed(main.select("band", "main", "inside", "outside"))}
    return sieve(once.where(F.col("n") <= block).select("band")), large, once.agg(F.sum("n")).first()[0] or 0


def _listed(table: DataFrame) -> list[tuple]:
    return list(zip(*(x.to_pylist() for x in table.toArrow().columns), strict=True))


def linked(
    members: DataFrame, sketches_of: Callable[[DataFrame], DataFrame], texts: Callable[[DataFrame], DataFrame], cut: Callable, similarity: float, block: int,
    near: Callable | None = None, cuts: Callable | None = None,
) -> DataFrame:
    """(node, root) of the candidates (band, id, centre, open) that are near copies.

    ``sketches_of`` and ``texts`` give (id, sketch) and (id, line) for a table of ids, each id
    once, and may give more; ``cut`` the set of shingles of a text; ``near`` whether pairs of
    sketches may be similar, else ``alike`` does.  ``cuts``, for short texts, gives the shingles of
    many (see ``similar``).
    """
    width = shuffle_width(members.sparkSession)
    near = near or functools.partial(alike, similarity=similarity)

    def both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        left = table.select(F.col("id").alias("a"), F.col(value).alias("left"))
        right = table.select(F.col("id").alias("b"), F.col(value).alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def packed_by_part(rows: DataFrame, pack: Callable, schema: str) -> DataFrame:
        return rows.mapInArrow(pack, schema).repartition(width, "part").sortWithinPartitions("part")

    # a row of an id has all that is known of it, so ids are joined, not their bands
    met_by_id = members.repartition("id").sortWithinPartitions("id").select("id", "centre", "band", "open")
    by_id = stored(met_by_id.mapInArrow(_by_id, "id long, centres array<long>, bands array<long>"))
    sketches = stored(sketches_of(by_id.select("id")))
    wheels = by_id.select("id", "centres").join(sketches, "id").select("id", "centres", "sketch")
    crowded = {x: math.ceil(n / CROWDED) for x, n in _listed(members.groupBy("centre").count().where(F.col("count") > CROWDED))}
    parts = max(width, math.ceil(members.count() / SPAN))
    likely = stored(packed_by_part(wheels, lambda it: _wheels(it, parts, crowded), _PACKED).mapInArrow(lambda it: _sorted_out(it, near), "a long, b long"))
    met = stored(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
    lines = stored(texts(met))
    links = settle(both(likely, lines, "line").mapInArrow(lambda it: _verified(it, cut, similarity, cuts), "a long, b long"))
    roots = connected_components(links)

    opens = by_id.select("id", "bands").where(F.size("bands") > 0).join(roots, F.col("id") == F.col("node"), "left")
    opens = stored(opens.select("id", F.coalesce("root", "id").alias("root"), "bands"))
    wanted, large, held = _open_bands(opens, block)
    shared = members.sparkSession.sparkContext.broadcast((wanted, large))
    dealt = opens.join(sketches, "id").select("id", "root", "bands", "sketch")
    tiles = max(width, math.ceil(held / SPAN))
    dealt = packed_by_part(dealt, lambda it: _laid_out(it, tiles, *shared.value), _PACKED)
    left = stored(dealt.mapInArrow(lambda it: _involved(it, near), "band long, low int, high int, side int, id long, root long"))
    places = stored(left.groupBy("id", "root").agg(F.collect_list(F.struct("band", "low", "high", "side")).alias("places")))
    more = stored(places.select("id").join(lines.select("id"), "id", "left_anti"))
    if not more.isEmpty():
        lines = lines.unionByName(stored(texts(more)).join(more, "id", "left_semi"))
    rest = places.join(sketches, "id").join(lines, "id").select("id", "root", "sketch", "line", "places")
    kind = lines.schema["line"].dataType.simpleString()
    split = max(width, math.ceil(left.count() / TEXTS))
    rest = packed_by_part(rest, lambda it: _texts_by_part(it, split), f"part int, places binary, id long, root long, sketch binary, line {kind}")
    rest = rest.mapInArrow(lambda it: _joined(it, cut, similarity, near, cuts), "a long, b long")
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
