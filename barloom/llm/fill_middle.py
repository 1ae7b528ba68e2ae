"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

While the units of a text are counted, every ``STEP``-th one leaves a checkpoint: its number,
and its offsets in bytes and in code points.  A cut is found by a binary search of the
checkpoints and a short rescan behind the one found, so a text of any length is scanned once
and no offset of every unit is kept.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between two checkpoints, and bytes that are counted at once.
STEP, BLOCK = 256, 1 << 16
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")
#: Bytes of output rows that a task holds before it hands them on, about.
HELD = 1 << 24


def _starts(data, at: int, end: int, unit: str):
    """Offsets from ``at`` of the bytes up to ``end`` that begin a unit, and which bytes begin a code point.

    A line begins behind a line feed, a word where a blank is followed by something else.
    """
    import numpy as np

    here = data[at:end]
    points = (here & 0xC0) != 0x80
    if unit == "char":
        return np.flatnonzero(points), points
    before = np.concatenate([data[at - 1 : at] if at else np.array([10], np.uint8), here[:-1]])
    if unit == "line":
        return np.flatnonzero(before == 10), points
    blank = lambda x: (x == 32) | ((x > 8) & (x < 14))
    return np.flatnonzero(blank(before) & ~blank(here)), points


class Index:
    """The sparse checkpoints of one text, given as an array of its UTF-8 bytes."""

    def __init__(self, data, unit: str = "char", step: int = STEP) -> None:
        import numpy as np

        self.data, self.unit, self.step = data, unit, step
        self.units = self.points = 0
        numbers, places, codes = [], [], []
        for at in range(0, len(data), BLOCK):
            starts, points = _starts(data, at, at + BLOCK, unit)
            first = -self.units % step  # the next unit whose number is a multiple of the step
            kept = starts[first::step]
            numbers.append(self.units + first + step * np.arange(len(kept)))
            places.append(kept + at)
            codes.append(numbers[-1] if unit == "char" else self.points + np.cumsum(points)[kept] - 1)
            self.units += len(starts)
            self.points += int(np.count_nonzero(points))
        #: Number, byte offset and code-point offset of each checkpoint.
        self.numbers, self.places, self.codes = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (numbers, places, codes))

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which a unit begins: the text's end behind the last one, its begin for the first."""
        import numpy as np

        if unit == 0:
            return 0, 0
        if unit >= self.units:
            return len(self.data), self.points
        slot = int(np.searchsorted(self.numbers, unit, "right")) - 1
        left, at, code = unit - int(self.numbers[slot]), int(self.places[slot]), int(self.codes[slot])
        while True:
            end = at + 4 * self.step
            starts, points = _starts(self.data, at, end, self.unit)
            if left < len(starts):
                return at + int(starts[left]), code + int(np.count_nonzero(points[: starts[left]]))
            left, at, code = left - len(starts), end, code + int(np.count_nonzero(points))


def _formed(name: bytes, text: bytes, unit: str, fim: int, spm: int, marks: tuple[bytes, ...]) -> tuple:
    """(units, form, code points of prefix, of middle, output) of a text; ``name`` draws its cuts and form."""
    import numpy as np

    index = Index(np.frombuffer(text, np.uint8), unit)
    n = index.units
    draws = struct.unpack(">4I", hashlib.sha256(name).digest()[:16])
    if not text or draws[2] % 100 >= fim or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, left), (b, right) = index.cut(first), index.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if draws[3] % 100 < spm:
        return n, "spm", left, right - left, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", left, right - left, b"".join((p, prefix, s, suffix, m, middle))


def _check(marks: tuple[str, ...]) -> None:
    """Marks must not hold or overlap one another, so that none arises where a piece and a mark meet."""
    if len(marks) != 3 or not all(marks):
        raise ValueError("three marks are needed")
    for i, x in enumerate(marks):
        for j, y in enumerate(marks):
            if (i != j and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"marks {x} and {y} overlap")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "char",
    fim_percent: int = 90,
    spm_percent: int = 20,
    seed: int = 1,
    marks: tuple[str, ...] = MARKS,
) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output): every text, reordered to train infilling.

    The sha256 of ``seed:id`` draws two of the n + 1 places between the text's units, which are
    code points, words (with the blanks behind them; blanks before the first belong to it) or
    lines, and whether the output is ``psm``, ``spm`` or the ``plain`` text.  Empty texts and
    those that hold a mark stay plain; null texts count as empty.  ``restored`` gives the text
    back.  Texts of any length are cut whole.  Equal ids with equal texts give equal rows, all
    null ids share one draw (of ``seed:``); an empty table gives an empty result, and other
    columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    _check(marks)
    codes = tuple(m.encode() for m in marks)

    def batches_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(ids, rows):
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            columns[4] = columns[4].view(pa.string())
            return pa.RecordBatch.from_arrays([ids, *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            ids, names, texts = (batch.column(i) for i in range(3))
            rows, held, begun = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(_formed(names[i].as_py() or b"", texts[i].as_py() or b"", unit, fim_percent, spm_percent, codes))
                held += len(rows[-1][4])
                if held > HELD or i == batch.num_rows - 1:
                    yield batch_of(ids.slice(begun, len(rows)), rows)
                    rows, held, begun = [], 0, i + 1

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), name.alias("name"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(batches_of, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output of that form was made from."""
    p, s, m = (F.lit(x) for x in marks)
    behind = lambda mark: F.split_part(output, mark, F.lit(2))
    before = lambda text, mark: F.split_part(text, mark, F.lit(1))
    psm = F.concat(before(behind(p), s), behind(m), before(behind(s), m))
    spm = F.concat(before(behind(p), m), behind(m), before(behind(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
