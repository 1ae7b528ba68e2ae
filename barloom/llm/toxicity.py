"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word comes in as a learned vector of its own and as the mean of learned vectors of its
character n-grams.  Two gated recurrent layers read a window of words, one from each end, and
attention pools their states into one number.  A text is scored in overlapping windows over
all its words, and the highest window counts, as a few words make a long text toxic.  The
network is numpy throughout; training is one task over a bounded sample, scoring is spread
over all tasks.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle

#: Words of a window, and from one window's begin to the next one's.
WINDOW, STRIDE = 40, 30
#: Size of a direction's state, and of the vector of a word and of its character n-grams.
STATE, WORD, CHARS = 16, 12, 12
GRAMS = (3, 4, 5)
#: Labelled documents of each label that the network is trained on, at most.
MAX_TRAIN = 1000
#: Words and n-grams with a vector of their own, at most; those of most training documents.
MAX_WORDS, MAX_GRAMS = 20_000, 40_000
#: Share of the training documents that a word or n-gram with a vector must be in (and in two at least): rarer ones are learnt by heart.
LEAST_IN = 1 / 200
#: Characters of a word; longer runs without a blank are cut.
LONG = 32
#: Characters that are cut into words at once, words of texts read together, words whose inputs a task keeps, windows in a step.
SLICE, GROUP, KEPT, STEP = 1 << 20, 1 << 17, 3 << 16, 512
#: Steps of the training, about, in at least and at most so many passes over the sample, a quarter of which treat all windows alike.
STEPS, LEAST_PASSES, MOST_PASSES = 400, 8, 20
BATCH, RATE, DECAY, SEED = 32, 0.01, 0.003, 12
THRESHOLD = 0.3
_TRIM = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def _words(text: str) -> list[str]:
    return text.lower().split()


def _grams(words: list[str]):
    """(hash of each character n-gram of the words, the word's place), by length and place of the n-gram."""
    import numpy as np

    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.array([len(w) + 2 for w in words], np.int64))
    codes, owners = [], []
    mixed = points * np.uint64(0x9E3779B97F4A7C15)
    for k in GRAMS:
        n = max(0, len(points) - k + 1)
        code = np.full(n, k, np.uint64)
        for i in range(k):  # a polynomial in an odd number
            code = code * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
        inside = owner[:n] == owner[k - 1 : k - 1 + n]
        codes.append((code ^ (code >> np.uint64(32)))[inside])
        owners.append(owner[:n][inside])
    return np.concatenate(codes), np.concatenate(owners)


def _slices(text: str) -> Iterator[str]:
    """A text in pieces of about ``SLICE`` characters, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank if blank > at else end
        yield text[at:end]
        at = end


class Network:
    """Parameters, vocabulary, and both passes; pickled into the tasks."""

    def __init__(self, words: list[str], grams, seed: int = SEED) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[-2])).astype(np.float32)
        #: Number of each known word, and the sorted hashes of the n-grams; 0 is any other one, whose vector stays zero.
        self.words = {w: i for i, w in enumerate(words, 1)}
        self.grams = np.sort(np.asarray(grams, np.uint64))
        #: Where the hashes that begin with the same 16 bits begin.
        self.slots = np.searchsorted(self.grams, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        table = lambda n, d: np.concatenate([np.zeros((1, d)), rng.standard_normal((n, d)) * 0.1]).astype(np.float32)
        self.p = {
            "words": table(len(words), WORD),
            "grams": table(len(grams), CHARS),
            # both directions side by side: update gate, reset gate, candidate
            "inputs": draw(WORD + CHARS, 6 * STATE),
            "bias": np.zeros(6 * STATE, np.float32),
            "states": draw(2, STATE, 3 * STATE),
            # attention weight and value of a state
            "pool": draw(2, STATE, 2),
            "base": np.zeros(1, np.float32),
        }
        #: Added to the logit, so that scores fit the labels' shares and not those of the sample.
        self.shift = 0.0

    def features(self, words: list[str]):
        """(numbers of the words, numbers of their known n-grams, whose n-grams they are, how many each word has)."""
        import numpy as np

        bare = [w.strip(_TRIM) or w for w in words]
        number = np.array([self.words.get(w, 0) for w in bare], np.int64)
        codes, owner = _grams(bare)
        # hashes are evenly spread, so those of the same 16 bits are few: a short walk finds one
        at = self.slots[(codes >> np.uint64(48)).astype(np.int64)]
        last = len(self.grams) - 1
        found = np.zeros(len(codes), np.int64)
        left = np.arange(len(codes)) if last >= 0 else np.zeros(0, np.int64)
        while len(left):
            here = at[left]
            inside = here <= last
            left, here = left[inside], here[inside]
            held = self.grams[here]
            same = held == codes[left]
            found[left[same]] = here[same] + 1
            left = left[held < codes[left]]
            at[left] += 1
        known = found > 0
        return number, found[known], owner[known], np.maximum(np.bincount(owner[known], minlength=len(words)), 1).astype(np.float32)

    def vectors(self, features):
        """Word and character vectors side by side."""
        import numpy as np

        number, grams, owner, known = features
        each = self.p["grams"][grams]
        chars = np.stack([np.bincount(owner, each[:, i], len(number)) for i in range(CHARS)], 1) / known[:, None]
        return np.concatenate([self.p["words"][number], chars.astype(np.float32)], 1)

    def projected(self, features):
        """The inputs of the gates for each word, first those of one direction, then those of the other."""
        import numpy as np

        x = self.vectors(features) @ self.p["inputs"] + self.p["bias"]
        return np.ascontiguousarray(x.reshape(-1, 2, 3 * STATE).transpose(1, 0, 2))

    def forward(self, rows, table, keep: list | None = None):
        """Logits of windows: ``rows`` (windows, words) are places in ``table`` of projected inputs, negative where a window has ended.

        ``keep`` receives what the backward pass needs.
        """
        import numpy as np

        n, length = rows.shape
        h = np.zeros((2, n, STATE), np.float32)
        scores = np.empty((2, length, n, 2), np.float32)
        full, half = bool((rows >= 0).all()), np.float32(0.5)
        for t in range(length):
            at = np.stack([rows[:, t], rows[:, length - 1 - t]])
            x = np.stack([table[0].take(at[0], 0, mode="wrap"), table[1].take(at[1], 0, mode="wrap")])
            u = np.matmul(h, self.p["states"])
            gates = x[..., : 2 * STATE] + u[..., : 2 * STATE]
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r = gates[..., :STATE], gates[..., STATE:]
            c = r * u[..., 2 * STATE :]
            c += x[..., 2 * STATE :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if not full:
                new = np.where((at >= 0)[..., None], new, h)
            if keep is not None:
                keep.append((at, h, z, r, c, u[..., 2 * STATE :], new))
            h = new
            scores[:, t] = h @ self.p["pool"]
        both = scores[0] + scores[1, ::-1]  # (word, window, attention and value)
        e = both[..., 0] if full else np.where((rows >= 0).T, both[..., 0], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        logit = (a * both[..., 1]).sum(0) + self.p["base"][0]
        if keep is not None:
            keep.append((a, both[..., 1], logit))
        return logit

    def logits(self, rows, table):
        import numpy as np

        return np.concatenate([self.forward(rows[i : i + STEP], table) for i in range(0, len(rows), STEP)])

    def gradients(self, rows, features, targets, weights):
        """Gradients of the weighted log loss of windows, whose words are rows of ``features``."""
        import numpy as np

        x = self.vectors(features)
        table = self.projected(features)
        keep: list = []
        logit = self.forward(rows, table, keep)
        a, value, _ = keep.pop()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dlogit = (1 / (1 + np.exp(-logit)) - targets) * weights
        g["base"][0] = dlogit.sum()
        dvalue = a * dlogit
        inner = (a * value).sum(0)
        datt = dvalue * (value - inner)
        dscores = np.stack([datt, dvalue], -1)  # (word, window, 2)
        dscores = np.stack([dscores, dscores[::-1]])
        dtable = np.zeros_like(table)
        dh = np.zeros((2, rows.shape[0], STATE), np.float32)
        for t in range(rows.shape[1] - 1, -1, -1):
            at, h, z, r, c, un, new = keep[t]
            g["pool"] += new.transpose(0, 2, 1) @ dscores[:, t]
            dh = dh + dscores[:, t] @ self.p["pool"].transpose(0, 2, 1)
            live = (at >= 0)[..., None]
            dnew = np.where(live, dh, 0)
            dc = dnew * (1 - z) * (1 - c * c)
            dz = dnew * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], -1)
            du = np.concatenate([dz, dr, dc * r], -1)
            g["states"] += h.transpose(0, 2, 1) @ du
            dh = np.where(live, dnew * z + du @ self.p["states"].transpose(0, 2, 1), dh)
            for k in range(2):
                some = at[k] >= 0
                np.add.at(dtable[k], at[k][some], dx[k][some])
        dtable = dtable.transpose(1, 0, 2).reshape(-1, 6 * STATE)
        number, grams, owner, known = features
        g["bias"] = dtable.sum(0)
        g["inputs"] = x.T @ dtable
        dx = dtable @ self.p["inputs"].T
        np.add.at(g["words"], number, dx[:, :WORD])
        np.add.at(g["grams"], grams, (dx[:, WORD:] / known[:, None])[owner])
        g["words"][0] = 0
        return g


class Reader:
    """Texts to windows, with the projected inputs of the words seen last."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.rows: dict[str, int] = {}
        self.table = np.zeros((2, 1024, 3 * STATE), np.float32)

    def add(self, words: list[str]) -> None:
        import numpy as np

        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            begin, end = len(self.rows), len(self.rows) + len(part)
            if end > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros((2, max(begin, end), 3 * STATE), np.float32)], 1)
            self.table[:, begin:end] = self.network.projected(self.network.features(part))
            self.rows.update(zip(part, range(begin, end), strict=True))

    def numbers(self, pieces: list[list[str]]) -> list:
        """The table's rows of the words of some pieces of text."""
        import numpy as np

        get = self.rows.get
        found = [list(map(get, words)) for words in pieces]
        some = [i for i, f in enumerate(found) if None in f]
        new: dict[str, None] = {}
        for i in some:
            words = [w for w, row in zip(pieces[i], found[i], strict=True) if row is None]
            if any(len(w) > LONG for w in words):
                pieces[i] = [w[j : j + LONG] for w in pieces[i] for j in range(0, len(w), LONG)]
                words = [w for w in pieces[i] if w not in self.rows]
            new.update(dict.fromkeys(words))
        self.add(list(new))
        for i in some:
            found[i] = list(map(get, pieces[i]))
        return [np.array(f, np.int32) for f in found]

    def logits(self, texts: list[str | None]):
        """The highest window's logit of each text; minus infinity for texts without words."""
        import numpy as np

        best = np.full(len(texts), -np.inf)
        pieces: list[list[str]] = []
        owner: list[int] = []

        def flush() -> None:
            numbers = self.numbers(pieces)
            ends = [i for i in range(len(owner)) if i + 1 == len(owner) or owner[i + 1] != owner[i]]
            held = [windows(np.concatenate(numbers[a + 1 : b + 1])) for a, b in zip([-1, *ends], ends, strict=False)]
            begins = np.cumsum([0, *map(len, held)])[:-1]
            best[[owner[i] for i in ends]] = np.maximum.reduceat(self.network.logits(np.concatenate(held), self.table), begins)
            pieces.clear(), owner.clear()
            if len(self.rows) > KEPT:
                self.clear()

        waiting = 0
        for k, text in enumerate(texts):
            if waiting >= GROUP:
                flush()
                waiting = 0
            for piece in _slices(text or ""):
                words = _words(piece)
                if words:
                    pieces.append(words)
                    owner.append(k)
                    waiting += len(words)
        if pieces:
            flush()
        return best


def windows(numbers):
    """All overlapping windows of a text's words, the last ones filled with -1."""
    import numpy as np

    n = max(1, -(-(len(numbers) - WINDOW) // STRIDE) + 1)
    padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int32)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _of_words(features, used) -> tuple:
    """The features of some words, by their sorted places, out of those of all."""
    import numpy as np

    number, grams, owner, known = features
    place = np.full(len(number), -1)
    place[used] = np.arange(len(used))
    mine = place[owner]
    return number[used], grams[mine >= 0], mine[mine >= 0], known[used]


def train(texts: list[str], labels: list[int], share: float, seed: int = SEED) -> Network:
    """A network from texts labelled 0 and 1, of which both must occur; ``share`` is that of label 1 among all.

    In the first passes every window bears its text's label; later on of texts labelled 1 only
    the highest window does, while those labelled 0 lend their highest ones and others by chance.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    seen, parts = Counter(), []
    for text in texts:
        bare = {w.strip(_TRIM) for piece in _slices(text) for w in _words(piece) if len(w) <= LONG} - {""}
        seen.update(bare)
        parts.append(np.unique(_grams(sorted(bare))[0]))
    least = max(2, math.ceil(LEAST_IN * len(texts)))
    words = [w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_WORDS] if c >= least]
    grams, counts = np.unique(np.concatenate(parts), return_counts=True)
    network = Network(words, grams[np.argsort(-counts, kind="stable")][: min(MAX_GRAMS, np.count_nonzero(counts >= least))], seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    label = np.array(labels, np.float32)
    names: dict[str, int] = {}
    held = []
    for text in texts:
        words = [w[i : i + LONG] for piece in _slices(text) for w in _words(piece) for i in range(0, len(w), LONG)]
        held.append(windows(np.array([names.setdefault(w, len(names)) for w in words] or [-1], np.int32)))
    whole = network.features(list(names))
    every, begins = np.concatenate(held), np.cumsum([0, *map(len, held)])
    step = 0
    passes = min(MOST_PASSES, max(LEAST_PASSES, -(-STEPS * BATCH // len(texts))))
    total = passes * -(-len(texts) // BATCH)
    mean = {k: np.zeros_like(v) for k, v in network.p.items()}
    averaged = 0
    for epoch in range(passes):
        top = None
        if epoch >= passes // 4:
            logits = network.logits(every, network.projected(whole))
            top = [int(logits[a:b].argmax()) for a, b in zip(begins, begins[1:], strict=False)]
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows, targets, weights = [], [], []
            for k in order[at : at + BATCH].tolist():
                some = rng.integers(0, len(held[k]), 4 if top is None else 0 if label[k] else 2).tolist()
                some += [] if top is None else [top[k]]
                rows += [held[k][i] for i in some]
                targets += [label[k]] * len(some)
                weights += [1 / len(some)] * len(some)
            rows = np.array(rows)
            used, local = np.unique(rows, return_inverse=True)
            local = local.reshape(rows.shape) - int(used[0] < 0)
            used = used[used >= 0]
            if not len(used):
                continue
            features = _of_words(whole, used)
            features[0][rng.random(len(used)) < 0.2] = 0  # so that the characters learn too
            grads = network.gradients(local, features, np.array(targets), np.array(weights, np.float32) / BATCH)
            step += 1
            rate = RATE * (0.05 + 0.95 * (1 + math.cos(math.pi * min(1, step / total))) / 2)
            for k, g in grads.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                network.p[k] *= 1 - DECAY if k in ("words", "grams") else 1
                network.p[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            if 3 * step > 2 * total:  # the parameters of the last third are averaged
                averaged += 1
                for k, v in network.p.items():
                    mean[k] += (v - mean[k]) / averaged
    if averaged:
        network.p = mean
    toxic = float(label.mean())
    odds = lambda p: math.log(p / (1 - p))
    network.shift = odds(min(max(share, 1e-6), 1 - 1e-6)) - odds(toxic)
    return network


def sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, most: int) -> tuple[DataFrame, int, int]:
    """(rows (id, label, text), labelled documents, those labelled 1): of each label at most ``most`` documents, by the hash of their id.

    An id with several labels has the highest, one with several texts the first by code point.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    mine = docs.where(train & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    # ids alone are joined and ordered; texts come once few ids are left
    found = settle(known.join(mine, "id", "left_semi").withColumn("hash", F.xxhash64("id")))
    n, ones = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    first = [found.where(F.col("label") == k).orderBy("hash", "id").limit(most) for k in (0, 1)]
    drawn = settle(first[0].unionByName(first[1]))
    texts = docs.where(train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "label", "hash").agg(F.min("text").alias("text"))
    return rows, n, ones


def trained(rows: DataFrame, share: float) -> bytes:
    """The pickled network of rows (hash, id, label, text), trained in one task; a few megabytes, as its vocabulary is bounded."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels, share))], pa.binary())], ["network"])

    ordered = rows.coalesce(1).sortWithinPartitions("hash", "id").select("text", "label")
    return bytes(ordered.mapInArrow(run, "network binary").first()[0])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = MAX_TRAIN,
) -> DataFrame:
    """Rows (id, train, score) for every row of ``docs``: how likely its text is labelled 1, from 0 to 1.

    The network learns from rows of ``docs`` where ``train`` holds, whose id ``labels`` marks 0
    or 1, at most ``most`` documents of each.  Where only one label occurs, each text with words
    has that label as its score; without labels it is 0.  Null, empty and blank texts score 0.
    Texts of any length are scored whole, runs of over ``LONG`` characters without a blank in
    pieces.  Repeated rows and null ids come back as given, equal texts score alike to within
    rounding, an empty table gives an empty result, and other columns are ignored.
    """
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows, n, ones = sample(docs, labels, train, id_col, text_col, label_col, most)
    slim = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    if ones in (0, n):
        wordless = F.trim(F.coalesce(F.translate("text", "\t\n\x0b\x0c\r", "     "), F.lit(""))) == ""
        return slim.select("id", "train", F.when(wordless, 0.0).otherwise(F.lit(1.0 if ones else 0.0)).alias("score"))
    network = trained(rows, ones / n)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        reader = None
        for batch in batches:
            reader = reader or Reader(pickle.loads(shared.value))
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-(reader.logits(batch.column(2).to_pylist()) + reader.network.shift)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["id", "train", "score"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, train boolean, score double")
