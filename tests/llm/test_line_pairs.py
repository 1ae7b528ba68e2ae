"""Pairs of lines that are verified many at once."""

import random

import pytest

from barloom.llm import lines, verify


@pytest.mark.parametrize("letters", [1 << 18, 40])
def test_many_pairs_as_one_by_one(monkeypatch, letters):
    monkeypatch.setattr(verify, "LETTERS", letters)
    rng, pairs = random.Random(6), [("", ""), ("a", "a"), ("a", "b"), ("\U0001f600" * 9, "\U0001f600" * 4), ("aaaaaaaa", "aaaaa"), ("\ud800bcdefg", "?bcdefg")]
    for _ in range(700):
        a = "".join(rng.choice("ab cdé") for _ in range(rng.randrange(60)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), "#")
        pairs.append((a, "".join(b)))
    left, right = (list(x) for x in zip(*pairs, strict=True))
    found = verify.similar(left, right, lines.all_shingles, 0.8)
    one = [verify.jaccard(lines.shingles(a), lines.shingles(b)) >= 0.8 for a, b in pairs]
    assert found.tolist() == one and 100 < sum(one) < 600


def test_lines_that_meet_outside_their_centres(spark):
    """Batches without a band to compare, and lines whose texts are fetched later, do no harm."""
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(80))
    texts = [base[:i] + "#" + base[i + 1 :] + str(j) for i in range(0, 80, 4) for j in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["id"] for r in lines.kept_lines(docs).collect() if len(r["kept"])}
    assert kept == {0}
