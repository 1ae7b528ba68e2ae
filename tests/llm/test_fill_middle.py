"""Fill-in-the-middle against a plain version, round trips and awkward tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import entries, fill_middle
from barloom.llm.fill_middle import Index, fill_in_middle, restored

ODD = ["", " ", "a", "é\U0001f600x", "\n\n", "a<P>b", "plain text", "<P", "x<S>", "ab<M", " two  words ", "l1\nl2\n", "ÿ" * 1000]


def plain_version(doc_id, text):
    """The contract in plain Python."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_equals_plain_version(spark):
    rng = random.Random(3)
    texts = ODD + [None] + ["".join(rng.choice("ab é\n\U0001f600<PSM>") for _ in range(rng.randint(0, 3000))) for _ in range(200)]
    texts += ["aé" * 200_000]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    done = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted(((r.id is None, r.id or 0), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect())
    want = sorted(((i is None, i or 0), *plain_version(i, x), x or "") for i, x in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_checkpoints_find_every_unit(unit):
    rng = random.Random(5)
    for step in (1, 3, 256):
        for text in ODD + ["".join(rng.choice(" ab é\n\t\U0001f600") for _ in range(4000)), " " * 5000 + "a" * 5000 + " b", "word " * 40_000]:
            data = text.encode()
            index = Index(np.frombuffer(data, np.uint8), unit, step)
            starts = {
                "char": list(range(len(text))),
                "line": [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"],
                "word": [i for i in range(len(text)) if text[i] not in " \t\n\v\f\r" and (i == 0 or text[i - 1] in " \t\n\v\f\r")],
            }[unit]
            assert (index.units, index.points) == (len(starts), len(text))
            assert len(index.numbers) == -(-len(starts) // step)
            for k in {0, 1, len(starts) // 2, len(starts) - 1, len(starts), *rng.sample(range(len(starts) + 1), min(20, len(starts)))}:
                if 0 <= k <= len(starts):
                    point = 0 if k == 0 else len(text) if k == len(starts) else starts[k]
                    assert index.cut(k) == (len(text[:point].encode()), point), (text[:20], unit, step, k)


@pytest.mark.parametrize("unit", ("word", "line"))
def test_units_are_not_broken(spark, unit):
    docs = spark.createDataFrame([(i, f"one two{i}\nthree  four\nfive é{i}") for i in range(40)], "doc_id long, text string")
    done = fill_in_middle(docs, unit=unit, fim_percent=100, spm_percent=0, seed=9).join(docs, F.col("id") == F.col("doc_id"))
    for r in done.withColumn("back", restored(F.col("output"), F.col("form"))).collect():
        assert r.back == r.text and r.form == "psm"
        for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
            before, behind = r.text[:at], r.text[at:]
            assert not before or not behind or (before[-1] == "\n" if unit == "line" else before[-1] in " \n" and behind[0] not in " \n")


def test_empty_table_and_marks(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for marks in (("<", "<S>", "<M>"), ("ab", "ba", "<M>"), ("", "x", "y")):
        with pytest.raises(ValueError, match="mark"):
            fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), marks=marks)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entries.op13_fill_middle(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, prefix, middle, output = plain_version(r.doc_id, r.text)
        x = got[r.doc_id]
        assert (x.n, x.form, x.prefix_chars, x.middle_chars) == (n, form, prefix, middle)
        assert x.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert x.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
