"""Secret scans: candidates of several kinds, of which a random forest removes the false positives.

Candidates are long tokens (dotted ones too), values assigned to names such as ``password``,
passwords in URLs, and private key blocks.  Each is described by its kind, its length and
alphabet, by how likely its character transitions are in ordinary words, by the part of it
that dictionary words cover, by how much it looks like a path, and by the words around it.
The dictionary holds the most frequent words of all texts that are scanned.  The forest
(Spark ML) is trained on labelled findings: texts with the place of a candidate and whether
it was a real secret.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import least_hashes

#: Labelled findings that the forest is fitted on, at most about; every text is scanned.
MAX_TRAIN = 50_000
TREES, DEPTH, SEED = 40, 8, 17
CONTEXT = 48
#: Words of the dictionary, at most; each is counted over all texts.
WORDS = 20_000
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----)[\s\S])*(?:-----END [A-Z0-9 ]*-----)?")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/@:]*:([^\s/@]+)@")
ASSIGNED = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|credentials?|(?:api|access|auth|private|account|encryption|signing)[_-]?key)[\"'`]?\]?\s{0,4}(?:=>|:=|==|[:=])\s{0,4}[\"'`]?([^\s\"'`,;]{6,})",
    re.IGNORECASE,
)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?:\.[A-Za-z0-9+/_\-]{8,})*={0,2}")
#: Each kind's pattern, the group that is the candidate, and strings of which a text with one has at least one.
KINDS = (
    ("block", BLOCK, 0, ("PRIVATE KEY",)), ("url", URL, 1, ("://",)),
    ("assigned", ASSIGNED, 1, ("pass", "pwd", "secret", "token", "credential", "key")), ("token", TOKEN, 0, ()),
)
WORD = re.compile(r"[A-Za-z]+")
# Words that ordinary identifiers, paths and placeholders are made of; they are in every dictionary.
BASE_WORDS = tuple(
    "about account address after all and any api app application archive array base before bin block body book build bytes call "
    "case change char check class client code color com command config content copy count create current data date default "
    "delete describe document docs domain email end error event example false field file first folder for format from function "
    "general get group handle hash header here home html http https image import index info input insert item java json key "
    "language large last lib library line list load local log long main make manager map max message method model module name "
    "network new node not null number object only open option order org other output page param parse password path platform "
    "print private process project public python query read record request require response result return root row sample "
    "save schema script search secret select self server service session set share short site size small sort source start "
    "state static status step string style system table test text that the this time title token true type update url user "
    "usr value var version view web window with word work write www xml year your".split()
)
# Words that stand next to real secrets, and next to look-alikes.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access")
PLAIN_WORDS = ("commit", "sha", "md5", "checksum", "digest", "uuid", "revision", "etag", "integrity", "hash", "id", "example", "placeholder", "git")
FEATURES = (
    "length", "digits", "uppers", "lowers", "symbols", "distinct", "entropy", "hex", "transitions", "switches", "longest_run",
    "dictionary", "slashes", "dashes", "path", "assigned", "quoted", "secret_words", "plain_words", "nearest", "placeholder",
    *[f"is_{kind}" for kind, *_ in KINDS],
)
PLACEHOLDER = re.compile(r"x{4,}|your|example|changeme|placeholder|dummy|sample|redacted|insert|none|null|true|false|todo|\*{3,}|<|\$\{|\{\{|%\(|\(\)|\[|getenv|environ|process\.env|config\.", re.IGNORECASE)


class Describer:
    """Features of candidates; the same in every process."""

    def __init__(self, dictionary: tuple[str, ...] = ()) -> None:
        import math

        dictionary = tuple(dict.fromkeys((*BASE_WORDS, *dictionary)))
        self.words = {w for w in dictionary if len(w) >= 3}
        pairs: dict[tuple[str, str], int] = {}
        firsts: dict[str, int] = {}
        for word in dictionary:
            for a, b in zip(word, word[1:], strict=False):
                pairs[a, b] = pairs.get((a, b), 0) + 1
                firsts[a] = firsts.get(a, 0) + 1
        letters = [chr(c) for c in range(97, 123)]
        #: log-probability of each transition, smoothed over the alphabet
        self.step = {(a, b): math.log((pairs.get((a, b), 0) + 0.2) / (firsts.get(a, 0) + 5.2)) for a in letters for b in letters}
        self.rare = math.log(0.2 / 30)

    def covered(self, low: str) -> int:
        """Letters of a lower-cased value that dictionary words cover, the longest first at each place."""
        at = total = 0
        while at < len(low) - 2:
            size = next((n for n in range(min(16, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            total += size
            at += size or 1
        return total

    def __call__(self, kind: str, before: str, value: str, after: str) -> list[float]:
        import math

        n = len(value)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
        counts: dict[str, int] = {}
        for c in value:
            counts[c] = counts.get(c, 0) + 1
        low = value.lower()
        steps = [self.step.get(p, self.rare) for p in zip(low, low[1:], strict=False)]
        run = longest = 1
        for a, b in zip(value, value[1:], strict=False):
            run = run + 1 if a == b or ord(b) - ord(a) == 1 else 1  # repeats and sequences such as 12345
            longest = max(longest, run)
        near = [w.lower() for w in WORD.findall(before)][-4:]
        far = near + [w.lower() for w in WORD.findall(after)][:2]
        tail = before.rstrip().rstrip("\"'`").rstrip()
        # "about how far back the last telling word is": 0 next to the value, 4 for none
        nearest = next((i for i, w in enumerate(reversed(near)) if any(s in w for s in SECRET_WORDS)), 4)
        return [
            float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n, len(counts) / n,
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            float(all(c in "0123456789abcdefABCDEF" for c in value)),
            sum(steps) / max(1, len(steps)),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            longest / n,
            self.covered(low[:512]) / min(n, 512),
            value.count("/") / n, (value.count("-") + value.count("_")) / n,
            float(before[-1:] in ("/", ".", "\\", "~") or after[:1] in ("/", ".", "\\") or "://" in before[-12:]),
            float(tail[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'", "`")),
            float(sum(any(s in w for s in SECRET_WORDS) for w in near)),
            float(sum(w in PLAIN_WORDS or w.startswith("sha") for w in far)),
            float(nearest), float(bool(PLACEHOLDER.search(value))), *[float(kind == k) for k, *_ in KINDS],
        ]


def candidates(text: str | None, describe: Describer) -> list[dict]:
    """(first_char, length, value, kind, features) of every candidate of a text; what a kind takes, later ones leave out."""
    text = text or ""
    low, taken, found = text.lower(), [], []
    for kind, pattern, group, signs in KINDS:
        if signs and not any(x.lower() in low for x in signs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "assigned" and text[a:b].rstrip(".)]}>") == "":
                continue
            if any(a < end and start < b for start, end in taken):
                continue
            taken.append((a, b))
            before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
            found.append({"first_char": a, "length": b - a, "value": text[a:b], "kind": kind, "features": describe(kind, before, text[a:b], after)})
    return sorted(found, key=lambda x: x["first_char"])


_HELD = "array<struct<first_char:long,length:int,value:string,kind:string,features:array<double>>>"


def dictionary_of(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> tuple[str, ...]:
    """The most frequent lower-cased words of 3 to 16 letters of all texts, at most ``words`` of them, ties by name."""
    import pyarrow as pa

    def counted(batches: Iterator) -> Iterator:
        from collections import Counter

        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(WORD.findall(text.lower()) if text else ())
            pairs = [(w, n) for w, n in counts.items() if 3 <= len(w) <= 16]
            names, numbers = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(words)
    return tuple(r["word"] for r in top.collect())


def _described(texts_of: DataFrame, text_col: str, dictionary: tuple[str, ...]) -> DataFrame:
    """Add ``held``, the candidates of each row's text."""
    import pandas as pd

    shared = texts_of.sparkSession.sparkContext.broadcast(dictionary)  # a bounded number of words

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        describe = Describer(shared.value)
        for texts in batches:
            yield pd.Series([candidates(x, describe) for x in texts.tolist()])

    scan = F.pandas_udf(column, _HELD, F.PandasUDFType.SCALAR_ITER)
    return texts_of.withColumn("held", scan(F.col(text_col).cast("string")))


def train(findings: DataFrame, dictionary: tuple[str, ...] = (), max_train: int = MAX_TRAIN) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (text, first_char, secret); none if only one label occurs.

    Where there are more than about ``max_train`` findings, those with the smallest hashes
    are taken.  Rows with a null in any of the columns, or whose place holds no candidate,
    are ignored.
    """
    known = findings.select("text", "first_char", "secret").dropna()
    part = max_train / max(1, known.count())
    if part < 1:
        known = known.where(least_hashes(F.xxhash64("text", "first_char"), part))
    rows = _described(known, "text", dictionary).select("first_char", "secret", F.explode("held").alias("x")).where("x.first_char = first_char")
    rows = rows.select(F.col("secret").cast("double").alias("label"), F.col("x.features").alias("features"))
    # a bounded table: one partition in a fixed order, so that reruns draw the same bootstrap samples
    rows = rows.coalesce(1).sortWithinPartitions("label", "features").select("label", array_to_vector("features").alias("features"))
    labels = [r[0] for r in rows.select("label").distinct().limit(2).collect()]
    if len(labels) < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(rows)


def example_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled findings (text, first_char, secret) of every kind, from a seeded generator of code, settings and notes."""
    import random
    import string

    rng = random.Random(SEED)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(BASE_WORDS)
    # words of any language: consonants and vowels in turn
    alien = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    note = lambda k: " ".join(rng.choice((word, alien))() for _ in range(k))
    names = ("token", "api_key", "apikey", "secret", "password", "auth_token", "client_secret", "access_key", "AWS_SECRET_ACCESS_KEY", "private_key", "db_password", "passwd", "PWD", "credentials")
    forms = ('{} = "', "{}: ", "{}='", '"{}": "', "export {}=", "{}=", "{} := ", "{} => '", '${}="')
    assigned = lambda: rng.choice(forms).format(rng.choice(names))
    mixed = lambda: draw(alnum, rng.randint(5, 9)) + rng.choice("!@#$%^&*") + draw(alnum, rng.randint(2, 6))

    def secret() -> tuple[str, str]:
        return rng.choice([
            lambda: (assigned(), draw(hexes, rng.choice((32, 40, 64)))), lambda: (assigned(), draw(alnum, rng.randint(18, 48))),
            lambda: (rng.choice(("key ", "", "is ", "use ", "Authorization: Bearer ", assigned())), draw(alnum + "+/", 40)),
            lambda: (rng.choice(("", "id ", assigned())), "AKIA" + draw(string.ascii_uppercase + string.digits, 16)),
            lambda: (rng.choice(("", "with ", assigned())), rng.choice(("ghp_", "sk-", "xoxb-", "glpat-", "npm_", "sk_live_")) + draw(alnum, rng.randint(24, 36))),
            lambda: (rng.choice(("Bearer ", assigned())), ".".join(("eyJ" + draw(alnum, 20), "eyJ" + draw(alnum, rng.randint(30, 60)), draw(alnum + "_-", 43)))),
            lambda: (assigned(), mixed()), lambda: (assigned(), draw(alnum, rng.randint(8, 15))),
            lambda: (f"{rng.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{word()}:", rng.choice((mixed, lambda: draw(alnum, rng.randint(8, 20))))().replace("@", "x").replace("/", "y")),
            lambda: ("", f"-----BEGIN {rng.choice(('RSA ', 'EC ', 'OPENSSH ', ''))}PRIVATE KEY-----\n" + "\n".join(draw(alnum + "+/", 64) for _ in range(rng.randint(2, 8))) + "\n-----END PRIVATE KEY-----"),
        ])()

    def plain() -> tuple[str, str]:
        return rng.choice([
            lambda: (rng.choice(("commit ", "sha1: ", "git revision ", "md5 = ", "checksum: ", "etag: ", "digest sha256:", "build ")), draw(hexes, rng.choice((32, 40, 64)))),
            lambda: (rng.choice(("uuid: ", "id ", "request ", "")), "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))),
            lambda: (rng.choice(("see /", 'path = "/', "in ~/", "from ./")), "/".join(word() for _ in range(rng.randint(4, 7)))),
            lambda: ("https://www.example.com/", "-".join(word() for _ in range(rng.randint(4, 7)))),
            lambda: (assigned(), rng.choice(("your", "my", "insert", "example")) + rng.choice("_-") + rng.choice("_-").join(word() for _ in range(3)) + rng.choice(("_here", ""))),
            lambda: (assigned(), rng.choice(("x", "0", "*", "1")) * rng.randint(8, 40)), lambda: (assigned(), rng.choice(("changeme", "<password>", "${SECRET_KEY}", "{{ token }}", "os.environ[KEY]", "getenv(TOKEN)", "config.password", "undefined", "required", "string;", "redacted"))),
            lambda: (assigned(), rng.choice(("_", ".", "")).join(word() for _ in range(rng.randint(2, 3)))), lambda: (f"the {rng.choice(names)}: ", alien() + alien() + alien()),
            lambda: ("call ", "".join(word().title() for _ in range(rng.randint(4, 6)))), lambda: ("", "_".join(word() for _ in range(rng.randint(4, 6)))),
            lambda: ("", "".join(alien() for _ in range(rng.randint(6, 9)))), lambda: (rng.choice(("", "account ", "number ")), draw("0123456789", rng.randint(16, 20))),
            lambda: ("", rng.choice("-_+/") * rng.randint(16, 40)), lambda: ("http://localhost:", "8080"), lambda: ("https://user:", rng.choice(("password", "<token>", "${TOKEN}", "xxxxxx"))),
            lambda: (rng.choice(("package-", "lib/")), f"{word()}-{word()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-linux-x86_64"),
        ])()

    rows = []
    while len(rows) < n:
        real = rng.random() < 0.5
        before, value = secret() if real else plain()
        lead, at = note(rng.randint(0, 8)), "@db.example.net/" if "://" in before else ""
        text = f"{lead} {before}{value}{at}{rng.choice(('', chr(34), ' '))} {note(rng.randint(0, 6))}"
        spot = len(lead) + 1 + len(before)
        if any(x["first_char"] == spot for x in candidates(text, lambda *_: [])):
            rows.append((text, spot, real))
    return spark.createDataFrame(rows, "text string, first_char long, secret boolean")


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    model: RandomForestClassificationModel | None = None,
    dictionary: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows (id, first_char, length, value, score, kind): the secrets in the texts of ``docs``.

    ``score`` is the forest's probability, and candidates below ``threshold`` are removed as
    false positives; if the labelled findings hold one label or none, every candidate stays,
    with a score of 1.  A ``model`` that was trained (and may have been saved) before is taken
    instead of ``findings``, with the ``dictionary`` of its training; without one the
    dictionary is that of ``docs``.  Places count characters from 0.  Whole texts are scanned.
    Null and empty texts hold nothing; repeated rows are reported as often as given and null
    ids are passed on.  An empty table gives an empty result; other columns are ignored.
    """
    dictionary = dictionary_of(docs, text_col) if dictionary is None else dictionary
    model = train(findings, dictionary) if model is None and findings is not None else model
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _described(slim, "text", dictionary).select("id", F.inline("held"))
    if model is None:
        return rows.select("id", "first_char", "length", "value", F.lit(1.0).alias("score"), "kind")
    judged = model.transform(rows.withColumn("features", array_to_vector("features")))
    scored = judged.select("id", "first_char", "length", "value", vector_to_array("probability")[1].alias("score"), "kind")
    return scored.where(F.col("score") >= threshold)
