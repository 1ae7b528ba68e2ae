"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product of its letters'
vectors, rotated by their places, a text the sum of its trigrams, a language prototype the
sum over its training texts.  A text gets the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import least_hashes

DIM = 1024
SEED = 7
#: Different texts that the prototypes are fitted on, at most about; all rows are classified.
MAX_TRAIN = 20_000
#: Languages whose prototypes a task compares at once; with more there are several passes of the comparison.
LANGUAGES = 4_096
CHUNK = 1 << 19
UNKNOWN = "und"
#: Letters below this code point keep it as their number; those above share the slots behind it.
PLAIN, SLOTS = 0x3000, 0x1000


class Encoder:
    """Trigram counts and vectors; the same in every process."""

    def __init__(self, dim: int = DIM) -> None:
        import unicodedata

        import numpy as np

        points = np.arange(0x110000, dtype=np.int64)
        kind = np.array([unicodedata.category(chr(x))[0] for x in range(0x110000)])
        number = np.where(points < PLAIN, points, PLAIN + (points * 2654435761 >> 7) % SLOTS)
        #: 0: no letter; -1: a combining mark, which is left out
        self.number = np.where(kind == "L", number, np.where(kind == "M", -1, 0))
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.known: dict[int, np.ndarray] = {}

    def letter(self, number: int):
        import numpy as np

        if number not in self.letters:
            bits = np.random.default_rng([SEED, number]).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[number] = bits * 2 - 1
        return self.letters[number]

    def vectors(self, codes):
        """The bound trigram vectors, one row a code."""
        import numpy as np

        if len(self.known) > 60_000:  # texts of many scripts: start again rather than grow
            self.known.clear()
        for code in codes.tolist():
            if code not in self.known:
                a, b, c = code >> 28, code >> 14 & 0x3FFF, code & 0x3FFF
                self.known[code] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return np.array([self.known[x] for x in codes.tolist()], np.float32).reshape(len(codes), self.dim)

    def counts(self, texts: list[str]):
        """Arrays (text, code, count) of the trigrams of lower-cased letters and single gaps."""
        import numpy as np

        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])[: len(points)]
        letters = self.number[points]
        letters, owner = letters[letters >= 0], owner[letters >= 0]
        keep = letters > 0
        keep[1:] |= (letters[:-1] > 0) | (owner[1:] != owner[:-1])  # one gap before and after a run of letters
        keep[:1] = True
        letters, owner = letters[keep], owner[keep]
        if len(letters) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = letters[:-2] << 28 | letters[1:-1] << 14 | letters[2:]
        inside = (owner[:-2] == owner[2:]) & (letters[1:-1] > 0)
        key, count = np.unique(owner[:-2][inside] << 42 | code[inside], return_counts=True)
        return key >> 42, key & ((1 << 42) - 1), count

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[list[int], object, object, object]]:
        """Rows of a batch and the counts of their texts, about ``CHUNK`` characters at a time."""
        import numpy as np

        rows: list[int] = []
        parts: list[str] = []
        size = 0
        for row, text in enumerate(texts):
            text = " " + text.lower() + " " if text else " "
            if len(text) > CHUNK:  # one very long text: its slices are counted one by one
                sums: dict[int, int] = {}
                for at in range(0, len(text), CHUNK):
                    _, code, count = self.counts([text[at : at + CHUNK + 2]])
                    for k, n in zip(code.tolist(), count.tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + n
                yield [row], np.zeros(len(sums), np.int64), np.array(list(sums), np.int64), np.array(list(sums.values()), np.int64)
                continue
            rows.append(row)
            parts.append(text)
            size += len(text)
            if size > CHUNK:
                yield rows, *self.counts(parts)
                rows, parts, size = [], [], 0
        if rows:
            yield rows, *self.counts(parts)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(dim: int) -> Encoder:
    if dim not in _ENCODERS:
        _ENCODERS[dim] = Encoder(dim)
    return _ENCODERS[dim]


def _weights(batches: Iterator, dim: int) -> Iterator:
    """(text, lang) to trigram weights (lang, code, weight); each text weighs about 65536."""
    import numpy as np
    import pyarrow as pa

    encoder = _encoder(dim)
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        keys, sums = [], []
        for rows, text, code, count in encoder.chunks(batch.column(0).to_pylist()):
            if not len(code):
                continue
            total = np.bincount(text, count, len(rows))
            weight = np.rint(count * 65536.0 / total[text]).astype(np.int64)
            lang = np.array([place[langs[r]] for r in rows])[text]
            key, at = np.unique(lang << 42 | code, return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, weight, len(key)).astype(np.int64))
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)
            lang = pa.array([names[i] for i in (key >> 42).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(key & ((1 << 42) - 1)), pa.array(total)], ["lang", "code", "weight"])


def prototypes(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """Rows (lang, vector): one prototype a language; rows with a null text or language are ignored."""
    import pandas as pd

    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    weights = rows.mapInArrow(lambda it: _weights(it, dim), "lang string, code long, weight long")

    def bundle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        encoder, vector = _encoder(dim), np.zeros(dim)
        part = part.sort_values("code")
        for at in range(0, len(part), 4096):
            block = part.iloc[at : at + 4096]
            vector += block.weight.to_numpy(float) @ encoder.vectors(block.code.to_numpy()).astype(float)
        return pd.DataFrame({"lang": [key[0]], "vector": [vector.tolist()]})

    sums = weights.groupBy("lang", "code").agg(F.sum("weight").alias("weight"))
    # the training rows are bounded, so a language's trigrams are too
    return sums.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>")


def _classified(texts: list[str | None], names: list[str], matrix, dim: int) -> tuple[list[str | None], object, object]:
    """The best language, its cosine, and whether there are letters, for each text; none where there is nothing to compare."""
    import numpy as np

    encoder = _encoder(dim)
    best, score, letters = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for rows, text, code, count in encoder.chunks(texts):
        if not len(code):
            continue
        letters[np.array(rows)[np.unique(text)]] = True
        if not len(names):
            continue
        seen, column = np.unique(code, return_inverse=True)
        vectors = np.zeros((len(rows), dim), np.float32)
        for at in range(0, len(seen), 4096):  # bundle: counts times bound trigrams
            here = (column >= at) & (column < at + 4096)
            bound = encoder.vectors(seen[at : at + 4096])
            table = np.zeros((len(rows), len(bound)), np.float32)
            table[text[here], column[here] - at] = count[here]
            vectors += table @ bound
        length = np.linalg.norm(vectors.astype(float), axis=1)
        some = np.zeros(len(rows), bool)
        some[text] = True
        rows = np.array(rows)[some]
        unit = vectors.astype(float)[some] / np.where(length > 0, length, 1)[some, None]
        top = np.full(len(rows), -np.inf)
        for at in range(0, len(names), LANGUAGES):
            cosine = unit @ matrix[at : at + LANGUAGES].T
            found = cosine.argmax(1)
            here = cosine[np.arange(len(rows)), found]
            better = here > top
            best[rows[better]] = at + found[better]
            top = np.maximum(top, here)
        score[rows] = top
    return [names[i] if i >= 0 else None for i in best.tolist()], np.clip(score, 0, 1), letters


def language(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, max_train: int = MAX_TRAIN
) -> Column:
    """A column (lang, score, letters) for the texts of ``docs``, from prototypes fitted on its ``train`` rows.

    Where the different texts of those rows are more than about ``max_train``, the prototypes
    are fitted on the ones with the smallest hashes; copies count once.
    """
    import numpy as np
    import pandas as pd

    fit = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    fit = fit.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    fit = fit.withColumn("hash", F.xxhash64("text"))
    part = max_train / max(1, fit.agg(F.approx_count_distinct("hash")).first()[0])
    if part < 1:
        fit = fit.where(least_hashes(F.col("hash"), part))
    fit = fit.groupBy("hash", "lang").agg(F.first("text").alias("text"))
    table = prototypes(fit, dim=dim).orderBy("lang").collect()  # one row a language; the sample bounds their number
    matrix = np.array([x["vector"] for x in table]).reshape(len(table), dim)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    names = [x["lang"] for x in table]
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score, letters = _classified(texts.tolist(), names, shared.value, dim)
            yield pd.DataFrame({"lang": [x or UNKNOWN for x in lang], "score": score, "letters": letters})

    scan = F.pandas_udf(classify, "lang string, score double, letters boolean", F.PandasUDFType.SCALAR_ITER)
    # so marked, a filter on the result does not make Spark classify every text twice
    return scan.asNondeterministic()(F.col(text_col).cast("string"))


def identify(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dim: int = DIM,
    max_train: int = MAX_TRAIN,
    held: Column | None = None,
) -> DataFrame:
    """Rows (id, held, lang_pred, score): a language for every row of ``docs``.

    The prototypes are fitted on rows where ``train`` holds and text and language are not
    null; where their different texts are more than about ``max_train``, on those with the
    smallest hashes of the text.  Whole texts are classified.  ``score`` is the cosine with the best
    prototype, at least 0; ties go to the language that sorts first.  Null texts, texts
    without a letter, and all texts if nothing can be trained on, get ``und`` and 0.
    Repeated rows and null ids come back as given; ``held`` is passed on.
    """
    held = F.lit(False) if held is None else held
    found = language(docs, train, text_col, lang_col, dim, max_train)
    named = docs.select(F.col(id_col).alias("id"), held.alias("held"), found.alias("found"))
    return named.select("id", "held", F.col("found.lang").alias("lang_pred"), "found.score")
