"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are sequences of lower-cased words.  The CGK random walk reads a
sequence in steps, staying on a word or going to the next by a random bit of (step, word); few
edits then become few differing places.  Repeated bit sampling hashes item-sized windows by the
words at sampled places.  Window hashes meet item hashes in a Spark join, and what meets is
verified by exact word edit distance (bit-parallel), with both ends of the text free.

Windows are embedded only where the q-gram lemma allows a match at all: ``e`` edits leave at
least ``n - q + 1 - q e`` of an item's ``n - q + 1`` word q-grams, so a window with fewer is
passed over; ``q`` is the largest of 3, 2, 1 for which that number is positive, as it always is
for 1.  That count loses nothing.  Items that allow no edit need no embedding: their windows
are equal or not.  For the others the number of repeats follows from the target recall by a
seeded simulation of the walks at the most edits allowed.

Items stay in tables.  What the tasks that read texts get of them is bit arrays of their
q-grams and hashes, of at most ``2 ** 27`` bits however many items there are, and a few
numbers for each class of lengths.  Fuller arrays let more windows through to the join; the
result stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Sieve, settle, shuffle_width, sieve

SIMILARITY, RECALL = 0.8, 0.99
SAMPLES, FIRST_REPEATS, MOST_REPEATS, SEED = 2, 256, 1 << 14, 5
CHUNK = 1 << 18
ROW = "row long, id {id}, class int, base long, words array<long>, keys array<long>"
FOUND = "item_id {item}, edits int, words int, similarity double, first_word long, last_word long"


class Lexer:
    """Words of UTF-8 bytes as 64-bit hashes.

    Words are runs of letters, digits and other non-ASCII characters but for general
    punctuation; characters of U+3040 to U+9FFF, which are written without blanks, are words
    of their own.
    """

    def __init__(self) -> None:
        import numpy as np

        self.powers = self.inverse = np.ones(1, np.uint64)
        octets = np.arange(256)
        self.inside = (octets >= 128) | np.isin(octets, list(b"abcdefghijklmnopqrstuvwxyz0123456789"))

    def _grow(self, size: int) -> None:
        import numpy as np

        base = 0x9E3779B97F4A7C15
        for name, factor in (("powers", base), ("inverse", pow(base, -1, 2**64))):
            table = np.full(2 * size, factor, np.uint64)
            table[0] = 1
            setattr(self, name, np.multiply.accumulate(table))

    def __call__(self, text: bytes):
        """(start, end, hash) of every word."""
        import numpy as np

        if len(text) >= len(self.powers):
            self._grow(len(text) + 1)
        octets = np.frombuffer(text, np.uint8)
        inside = self.inside[octets]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        if len(octets) and octets.max() >= 0xE2:
            follows = np.append(octets[1:], np.uint8(0))
            marks = ((octets == 0xE2) & ((follows == 0x80) | (follows == 0x81))) | ((octets == 0xE3) & (follows == 0x80))
            marks[2:] |= marks[:-2] | marks[1:-1]
            marks[1:2] |= marks[:1]
            inside = inside & ~marks
            alone = (octets >= 0xE3) & (octets <= 0xE9) & inside
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins |= alone
            begins[3:] |= alone[:-3] & inside[3:]
        ends = np.append(inside, False)
        ends[1:-1] = inside[:-1] & (begins[1:] | ~inside[1:])
        ends[0] = False
        if len(octets):
            ends[-1] = inside[-1]
        start, end = np.nonzero(begins)[0], np.nonzero(ends)[0]
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.powers[: len(octets)], out=sums[1:])
        value = (sums[end] - sums[start]) * self.inverse[start]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return start, end, value ^ (value >> np.uint64(27))


def _raw(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def _grams(words, q: int):
    import numpy as np

    total = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for k in range(q):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(total)]
    return _mixed(total ^ (total >> np.uint64(29)), q)


def _mixed(values, salt: int):
    import numpy as np

    values = (values ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return values ^ (values >> np.uint64(31))


def _edits_allowed(n: int, similarity: float) -> int:
    return int(math.floor((1 - similarity) * n + 1e-9))


def _distances(pattern: list[int], text: list[int]) -> Iterator[int]:
    """Edit distance of the pattern to the best run of text that ends at each word (bit-parallel)."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = {}
    for i, x in enumerate(pattern):
        places[x] = places.get(x, 0) | 1 << i
    plus, minus, score = full, 0, n
    for x in text:
        eq = places.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        yield score


class Walks:
    """The walks and sampled places of one class of lengths; the same in every process."""

    def __init__(self, number: int, shortest: int, repeats: int) -> None:
        import numpy as np

        # walks over n words last about 2 n steps: only steps that nearly all of them reach are sampled
        steps = max(1, int(2 * shortest - 2 * math.sqrt(2 * shortest)))
        rng = np.random.default_rng([SEED, number])
        places = np.sort(rng.integers(0, steps, (max(repeats, 4 * FIRST_REPEATS), SAMPLES)), axis=1)[:repeats]
        order = np.argsort(-places[:, -1], kind="stable")  # repeats that end early come last
        self.places, self.names = places[order], order.astype(np.uint64)
        self.salts = _mixed(np.arange(steps, dtype=np.uint64)[:, None] << np.uint64(20) | self.names, number)
        self.number = number

    def keys(self, words, start, end):
        """One hash for each window words[start:end] and each repeat."""
        import numpy as np

        padded = np.append(words, np.uint64(0))
        at = np.repeat(np.asarray(start)[:, None], len(self.places), 1)
        limit = np.minimum(np.asarray(end), len(words))[:, None]
        keys = np.repeat(_mixed(self.names, self.number)[None, :], len(at), 0)
        for step in range(int(self.places[0, -1]) + 1):
            live = int(np.searchsorted(-self.places[:, -1], -step, "right"))  # repeats that still sample here or later
            here = at[:, :live]
            inside = here < limit
            word = padded[np.where(inside, here, len(words))]
            for k in range(SAMPLES):
                take = np.nonzero(self.places[:live, k] == step)[0]
                if len(take):
                    keys[:, take] = _mixed(keys[:, take] ^ word[:, take], k)
            bits = (word ^ self.salts[step, :live]) * np.uint64(0xC2B2AE3D27D4EB4F)
            here += (bits >> np.uint64(63)).astype(at.dtype) * inside
        return keys


def _repeats_needed(number: int, shortest: int, longest: int, similarity: float, recall: float) -> int:
    """Repeats at which simulated walks over items and copies with the most edits meet often enough."""
    import numpy as np

    rng, most = np.random.default_rng([SEED, 1, number]), 1
    for n in sorted({shortest, longest}):
        edits = _edits_allowed(n, similarity)
        if not edits:
            continue
        pairs = max(40, min(300, 60_000 // n))
        items, copies, bounds = [], [], [0]
        for _ in range(pairs):
            item = rng.integers(0, 2**64, n, dtype=np.uint64)
            copy = item.tolist()
            for _ in range(edits):  # replaced, inserted and removed words
                at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
                copy[at : at + (kind != 1)] = rng.integers(0, 2**64, int(kind != 2), dtype=np.uint64).tolist()
            items.append(item)
            copies += [*copy, *rng.integers(0, 2**64, longest, dtype=np.uint64).tolist()]
            bounds.append(len(copies))
        start, begin = np.arange(pairs) * n, np.array(bounds[:-1])
        tried = FIRST_REPEATS
        while True:
            walks = Walks(number, shortest, tried)
            ours = walks.keys(np.concatenate(items), start, start + n)
            theirs = walks.keys(np.array(copies, np.uint64), begin, begin + longest)
            agree = (ours == theirs)[:, np.argsort(walks.names)]
            first = np.sort(np.where(agree.any(1), agree.argmax(1), tried))[math.ceil(recall * pairs) - 1]
            if first < tried:
                break
            tried *= 4
            if tried > MOST_REPEATS:
                raise ValueError(f"a recall of {recall} of items of {shortest} words takes more than {MOST_REPEATS} walks: ask for a higher similarity or a lower recall")
        most = max(most, int(first) + 1)
    return most


@dataclass(frozen=True)
class Lengths:
    """A class of item lengths: the q-grams that its windows need and the repeats of its walks."""

    number: int
    shortest: int
    longest: int
    edits: int
    q: int
    least: int
    repeats: int


def _class_of(n: int) -> int:
    return round(math.log(n, 1.2))


def _lengths(number: int, shortest: int, longest: int, similarity: float, recall: float) -> Lengths:
    sizes = range(shortest, longest + 1)

    def bound(q: int) -> int:
        return min(n - q + 1 - q * _edits_allowed(n, similarity) for n in sizes)

    q = next((q for q in (3, 2) if bound(q) >= 1), 1)
    edits = _edits_allowed(longest, similarity)
    return Lengths(number, shortest, longest, edits, q, bound(q), _repeats_needed(number, shortest, longest, similarity, recall))


def _worded(batches: Iterator) -> Iterator:
    """(item_id, text) to (item_id, class, words); items without words go."""
    import pyarrow as pa

    lexer = Lexer()
    for batch in batches:
        words = [lexer(_raw(x))[2].view("i8") for x in batch.column(1).to_pylist()]
        keep = [i for i, x in enumerate(words) if len(x)]
        columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([_class_of(len(words[i])) for i in keep], pa.int32())]
        lists = pa.array([words[i] for i in keep], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, lists], ["item_id", "class", "words"])


def _item_hashes(batches: Iterator, classes: dict[int, Lengths]) -> Iterator:
    """(item, class, words) to (item, grams, keys), gram hashes alone and with the class."""
    import numpy as np
    import pyarrow as pa

    walks = {k: Walks(k, x.shortest, x.repeats) for k, x in classes.items()}
    for batch in batches:
        grams, keys = [], []
        for k, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = np.array(words, np.int64).view(np.uint64)
            own = _grams(words, classes[k].q)
            grams.append(np.concatenate([own, _mixed(own, k)]).view(np.int64))
            keys.append(walks[k].keys(words, [0], [len(words)])[0].view(np.int64))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (grams, keys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["item", "grams", "keys"])


class Search:
    """What the tasks that read texts need: the classes, their walks, the sieves of the items."""

    def __init__(self, classes: dict[int, Lengths], grams: Sieve, keys: Sieve) -> None:
        self.classes, self.grams, self.keys = classes, grams, keys
        self.walks = {k: Walks(k, x.shortest, x.repeats) for k, x in classes.items()}
        #: words that a slice of a long text repeats of the one before
        self.overlap = max((x.longest + x.edits for x in classes.values()), default=1)

    def windows(self, words, cuts) -> Iterator[tuple[Lengths, int, int, int]]:
        """(class, first word, end, starts) of runs of windows with enough common q-grams; pieces end at ``cuts``."""
        import numpy as np

        found = {}
        for q in {x.q for x in self.classes.values()}:
            grams = _grams(words, q)
            at = np.nonzero(self.grams(grams))[0]
            piece = np.searchsorted(cuts, at, "right") - 1
            inside = at + q <= cuts[np.minimum(piece + 1, len(cuts) - 1)]
            found[q] = at[inside], grams[at[inside]], piece[inside]
        for k, one in self.classes.items():
            at, grams, piece = found[one.q]
            if len(at) < one.least:
                continue
            mine = self.grams(_mixed(grams, k))
            at, piece = at[mine], piece[mine]
            if len(at) < one.least:
                continue
            reach, last = one.longest + one.edits - one.q, one.least - 1
            first, final, owner = at[: len(at) - last], at[last:], piece[: len(at) - last]
            ok = (final - first <= reach) & (owner == piece[last:])
            if not ok.any():
                continue
            first, final, owner = first[ok], final[ok], owner[ok]
            opens = np.bincount(np.maximum(final - reach, cuts[owner]), minlength=len(words) + 1)
            closes = np.bincount(first + 1, minlength=len(words) + 1)
            starts = np.nonzero(np.cumsum(opens[: len(words)] - closes[: len(words)]) > 0)[0]
            owner = np.searchsorted(cuts, starts, "right") - 1
            # starts that are near each other share one run of words
            new = np.nonzero((np.diff(starts) > reach) | (np.diff(owner) > 0))[0] + 1
            for part in np.split(starts, new):
                a, b = cuts[owner[np.searchsorted(starts, part[0])] :][:2]
                yield one, max(a, part[0] - one.edits), min(b, part[-1] + one.longest + one.edits), part

    def rows(self, words, cuts) -> Iterator[tuple[int, int, object, object]]:
        """(class, first word, words, keys) of the runs whose windows share a hash with an item."""
        import numpy as np

        for one, first, end, starts in self.windows(words, cuts):
            keys = []
            for at in range(0, len(starts), 1024):
                part = starts[at : at + 1024]
                stop = cuts[np.searchsorted(cuts, part, "right")]
                if one.edits:
                    now = self.walks[one.number].keys(words, part, np.minimum(part + one.longest, stop)).ravel()
                else:  # equal windows or none, of any length of the class
                    now = np.concatenate([
                        self.walks[one.number].keys(words, part[part + n <= stop], (part + n)[part + n <= stop]).ravel()
                        for n in range(one.shortest, one.longest + 1)
                    ])
                keys.append(np.unique(now[self.keys(now)]))
            keys = np.unique(np.concatenate(keys))
            if len(keys):
                yield one.number, first, words[first:end], keys


def _slices(raw: bytes, lexer: Lexer, overlap: int) -> Iterator[tuple[int, object]]:
    """(place of the first word, words) of slices of a text; each repeats the last ``overlap`` words of the one before."""
    at, place, size = 0, 0, CHUNK
    while True:
        part = raw[at : at + size]
        start, _, words = lexer(part)
        if at + size >= len(raw):
            yield place, words
            return
        if len(words) < 2 * overlap + 2:  # too few words to go on from: a longer slice
            size *= 2
            continue
        yield place, words[:-1]  # the last word may be cut off
        back = len(words) - 1 - overlap
        place, at, size = place + back, at + int(start[back]), CHUNK


def _candidates(batches: Iterator, search: Search) -> Iterator:
    """(id, text) to rows of ``ROW``."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    lexer, counter = Lexer(), TaskContext.get().partitionId() << 36
    for batch in batches:
        out: list[tuple] = []

        def flush(parts: list[bytes], owners: list[int]) -> None:
            start, _, words = lexer(b"\n".join(parts))
            cuts = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in parts)]))
            for k, first, run, keys in search.rows(words, cuts):
                piece = int(np.searchsorted(cuts, first, "right")) - 1
                out.append((owners[piece], k, int(first - cuts[piece]), run, keys))

        parts, owners, size = [], [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = _raw(text)
            if len(raw) > CHUNK:
                for place, words in _slices(raw, lexer, search.overlap):
                    for k, first, run, keys in search.rows(words, np.array([0, len(words)])):
                        out.append((i, k, place + int(first), run, keys))
                continue
            if size + len(raw) > CHUNK:
                flush(parts, owners)
                parts, owners, size = [], [], 0
            if raw:
                parts.append(raw)
                owners.append(i)
                size += len(raw) + 1
        if parts:
            flush(parts, owners)
        if out:
            row, k, base, runs, keys = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([counter + i for i in row], pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(k, pa.int32()),
                    pa.array(base, pa.int64()), *[pa.array([x.view(np.int64) for x in y], pa.list_(pa.int64())) for y in (runs, keys)],
                ],
                ["row", "id", "class", "base", "words", "keys"],
            )
        counter += batch.num_rows


def _verified(batches: Iterator, similarity: float) -> Iterator:
    """(row, base, words, item, pattern) to (row, item, edits, first, last) of what is similar enough."""
    import pyarrow as pa

    names = ["row", "item", "edits", "first", "last"]
    for batch in batches:
        out = []
        for row, base, text, item, pattern in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            n = len(pattern)
            allowed = _edits_allowed(n, similarity)
            edits, last = min(((d, i) for i, d in enumerate(_distances(pattern, text))), default=(n, 0))
            if edits <= allowed:
                back = text[max(0, last - n - allowed) : last + 1][::-1]
                _, length = min((d, i + 1) for i, d in enumerate(_distances(pattern[::-1], back)))
                out.append((row, item, edits, base + last - length + 1, base + last))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    least_words: int = 1,
) -> DataFrame:
    """Rows (id, item_id, edits, words, similarity, first_word, last_word): items found in texts.

    A text holds an item if some run of its words is within ``1 - similarity`` times the
    item's words in edits; the best such run is given, counted in words from 0.  Items of one
    to four words allow no edit at 0.8 and are found exactly; ``least_words`` leaves shorter
    items out.  An item at the bound is found with about the probability ``recall``, one with
    fewer edits with more.  Texts are read whole, long ones in slices that overlap by the
    longest item.  Null and empty texts hold nothing; repeated rows are searched and reported
    separately, as are items of equal texts; null ids are passed on, and ids of any type.
    Items without a word are left out.  An empty table on either side gives an empty result;
    other columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity has to be above 0 and at most 1")
    spark = docs.sparkSession
    kinds = {"id": docs.schema[id_col].dataType.simpleString(), "item": benchmark.schema[item_col].dataType.simpleString()}
    given = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    worded = given.mapInArrow(_worded, f"item_id {kinds['item']}, class int, words array<long>").where(F.size("words") >= least_words)
    worded = settle(worded.withColumn("item", F.xxhash64("words")))
    # equal texts are searched once; one row for each class of lengths reaches the driver
    items = worded.groupBy("item").agg(F.first("class").alias("class"), F.first("words").alias("words"))
    found = items.groupBy("class").agg(F.min(F.size("words")), F.max(F.size("words"))).orderBy("class").collect()
    classes = {k: _lengths(k, a, b, similarity, recall) for k, a, b in found}
    hashed = settle(items.mapInArrow(lambda it: _item_hashes(it, classes), "item long, grams array<long>, keys array<long>"))
    shared = spark.sparkContext.broadcast(Search(classes, *[sieve(hashed.select(F.explode(c).alias("x"))) for c in ("grams", "keys")]))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = slim.mapInArrow(lambda it: _candidates(it, shared.value), ROW.format(**kinds))
    runs = settle(runs.withColumn("run", F.xxhash64("row", "class", "base")))
    met = runs.select("run", F.explode("keys").alias("key")).join(hashed.select("item", F.explode("keys").alias("key")), "key")
    pairs = met.select("run", "item").distinct()
    pairs = pairs.join(runs.select("run", "row", "base", "words"), "run").join(items.select("item", F.col("words").alias("pattern")), "item")
    pairs = pairs.select("row", "base", "words", "item", "pattern").repartition(shuffle_width(spark))
    held = pairs.mapInArrow(lambda it: _verified(it, similarity), "row long, item long, edits int, first long, last long")
    best = held.groupBy("row", "item").agg(F.min(F.struct("edits", "first", "last")).alias("best"))
    named = best.join(runs.select("row", "id").distinct(), "row").join(worded.select("item", "item_id", F.size("words").alias("words")), "item")
    return named.select(
        "id", "item_id", F.col("best.edits").alias("edits"), "words", (1 - F.col("best.edits") / F.col("words")).alias("similarity"),
        F.col("best.first").alias("first_word"), F.col("best.last").alias("last_word"),
    )
