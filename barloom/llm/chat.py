"""Chat formatting: schema fingerprints choose the mapping to canonical turns.

A record's fingerprint is the hash of the nested field paths that it fills.  Every mapping
states the paths of its layout, so its fingerprints are known beforehand, and a row's
fingerprint selects the declarative mapping that turns it into (role, text) turns.  The
turns are then written with marks between them; marks that occur inside texts are escaped
so that the turns can be read back.  Only built-in DataFrame functions are used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat tokenizers give a meaning to; none survives inside a formatted text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it fills (some may be empty) and where its turns are.

    ``fields`` lists (role, paths) in order, the paths' texts joined by a blank line; or
    ``array``, ``role`` and ``text`` name an array of turns and two fields of its elements.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""

    def fingerprints(self) -> list[int]:
        """Hashes of every set of paths that a record of this layout may fill."""
        sets = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [path_hash([*self.required, *x]) for x in sets]


def path_hash(paths: list[str]) -> int:
    """The number that ``fingerprint`` gives a row that fills these paths."""
    import xxhash

    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - 2**64 if value >= 2**63 else value


MAPPINGS = (
    Mapping("rows", ("turns[].at",), ("turns[].role", "turns[].text"), array="turns", role="role", text="text"),
    Mapping("messages", ("messages[].role",), ("messages[].content",), array="messages", role="role", text="content"),
    Mapping("exchanges", ("conversations[].from",), ("conversations[].value",), array="conversations", role="from", text="value"),
    Mapping(
        "instruction", ("instruction", "output"), ("input", "system"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping("prompt", ("prompt", "completion"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), ("context",), fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
#: Role names of the layouts that have names of their own for them.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _leaves(kind: T.DataType, path: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """Each leaf path under a field and the test whether a value fills it."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, x) for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [(p, _of_field(name, test)) for name, (p, test) in inner]
    if isinstance(kind, T.ArrayType):
        return [(p, _of_elements(test)) for p, test in _leaves(kind.elementType, f"{path}[]")]
    return [(path, lambda c: c.isNotNull())]


def _of_field(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: test(c.getField(name))


def _of_elements(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.exists(c, lambda x: test(x))


def fingerprint(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of the sorted nested paths that a row fills, out of those that any mapping knows."""
    known = {p for m in mappings for p in (*m.required, *m.optional)}
    filled = []
    for field in records.schema.fields:
        for path, test in _leaves(field.dataType, field.name):
            if path in known:
                filled.append(F.when(F.coalesce(test(F.col(f"`{field.name}`")), F.lit(False)), F.lit(path)))
    if not filled:
        return F.xxhash64(F.lit(""))
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*filled))), "\n"))


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, role), role, F.lit(""))


def _mapped(mapping: Mapping, schema: T.StructType) -> Column | None:
    """A mapping's turns, or none where the table has no such columns."""
    names = set(schema.fieldNames())
    if not {p.split("[")[0] for p in mapping.required} <= names:
        return None
    if mapping.array:
        inner = schema[mapping.array].dataType
        element = inner.elementType if isinstance(inner, T.ArrayType) else None
        if not isinstance(element, T.StructType) or not {mapping.role, mapping.text} <= set(element.fieldNames()):
            return None
        turn = lambda x: F.struct(
            _role(x[mapping.role].cast("string")).alias("role"), F.coalesce(x[mapping.text].cast("string"), F.lit("")).alias("text")
        )
        return F.transform(F.col(mapping.array), turn)
    turns = []
    for role, paths in mapping.fields:
        if there := [F.col(p).cast("string") for p in paths if p in names]:
            given = F.array_compact(F.array(*there))
            text = F.array_join(F.filter(given, lambda x: x != ""), "\n\n")
            # an optional part that is absent makes no turn
            turns.append(F.when(F.size(given) > 0, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*turns))


def _free(records: DataFrame, name: str) -> str:
    """A column name that the records do not have."""
    while name in records.columns:
        name += "_"
    return name


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``layout`` (the mapping's name) and ``turns`` to records of any known layouts; columns of these names are replaced.

    Paths that no mapping knows are ignored.  A record whose paths fit no mapping gets a
    null layout and no turns.  Null texts are empty.
    """
    fp, made = _free(records, "fp"), _free(records, "made")
    held = records.withColumn(fp, fingerprint(records, mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in mappings:
        if (mapped := _mapped(mapping, records.schema)) is not None:
            mine = F.col(fp).isin(mapping.fingerprints())
            layout, turns = F.when(mine, F.lit(mapping.name)).otherwise(layout), F.when(mine, mapped).otherwise(turns)
    named = held.withColumns({"layout": layout, made: F.coalesce(turns, F.array().cast(TURNS))})
    return named.drop(fp, "turns").withColumnRenamed(made, "turns")


def rows_to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record (id, turns) a conversation from one row a turn.

    Rows are ordered by turn, null first, then role and text; repeated rows are repeated
    turns.  Null ids form one conversation.  A conversation is one output row, so it has to
    fit into one task, as its text has to.
    """
    turn = F.struct(F.col(turn_col).alias("at"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    gathered = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    place = lambda x, i: F.struct(i.alias("at"), x["role"].alias("role"), x["text"].alias("text"))
    return gathered.select("id", F.transform("turns", place).alias("turns"))


def escape(text: Column) -> Column:
    """Break every control string with a backslash after its first character; double backslashes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(records: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` to records with ``turns``; columns of these names are replaced.

    A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.
    ``loss_spans`` are (start, length) in characters of the assistant texts, escapes
    included.
    """
    def piece(turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), F.replace(escape(turn["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
        body = escape(turn["text"])
        return F.struct(
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("whole"),
            F.char_length(head).alias("head"),
            F.char_length(body).alias("body"),
            (turn["role"] == "assistant").alias("loss"),
        )

    pieces = _free(records, "pieces")
    cut = records.withColumn(pieces, F.transform("turns", piece))
    tail = len(CLOSE) + 1
    size = lambda x: (x["head"] + x["body"] + tail).cast("long")
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + size(x))
    spans = F.transform(
        pieces, lambda x, i: F.when(x["loss"], F.struct((before(i) + x["head"]).alias("start"), x["body"].cast("long").alias("length")))
    )
    return cut.withColumns(
        {"formatted": F.array_join(F.transform(pieces, lambda x: x["whole"]), ""), "loss_spans": F.array_compact(spans)}
    ).drop(pieces)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, r"\Q" + CLOSE + "\n" + r"\E")
    header = r"(?s)^\Q" + OPEN + r"\E([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, header, 1)
        start = F.char_length(role) + len(OPEN) + 2
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, start, F.char_length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))
    return F.array_join(F.transform(spans, part), "")
