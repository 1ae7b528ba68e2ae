"""Bounds that neither drop rows nor change a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid
from barloom.llm.common import least_hashes


def test_no_share_is_too_small(spark):
    hashes = spark.createDataFrame([(-(2**63),), (-(2**63) + 2**33,), (0,), (2**63 - 1,)], "h long")
    count = lambda part: hashes.where(least_hashes(F.col("h"), part)).count()
    assert [count(p) for p in (0.0, 2**-64, 2**-30, 0.5, 0.6, 1.0)] == [1, 1, 2, 3, 3, 4]
    many = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert many.where(least_hashes(F.col("h"), 0.25)).count() == pytest.approx(50_000, rel=0.03)


def test_a_tiny_sample_still_learns(spark):
    docs = spark.createDataFrame([(i, f"{w} number {i}", w) for i in range(300) for w in ("alpha", "beta")], "doc_id long, text string, lang string")
    found = langid.identify(docs, F.lit(True), max_train=60)
    assert found.where("lang_pred = 'und'").count() == 0


def test_languages_have_no_limit(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [f"{a}{b}{a} {b}{a}{b}{b}" for a in "bcdfg" for b in "aeiou"]
    matrix = np.zeros((len(texts), 256))
    encoder = langid._encoder(256)
    for rows, text, code, count in encoder.chunks(texts):
        for r in range(len(rows)):
            mine = text == r
            matrix[rows[r]] = count[mine] @ encoder.vectors(code[mine])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    names = [f"l{i:02}" for i in range(len(texts))]
    whole = langid._classified(texts, names, matrix, 256)
    monkeypatch.setattr(langid, "LANGUAGES", int(rng.integers(2, 6)))
    parts = langid._classified(texts, names, matrix, 256)
    assert whole[0] == parts[0] == names
    np.testing.assert_allclose(whole[1], parts[1])


def test_independent_bundles_and_cosines(spark):
    """Profiles and scores against letter vectors that are bound and bundled one by one."""
    dim, train = 128, [("der die das", "de"), ("the of and", "en"), ("the und", "en")]
    encoder = langid._encoder(dim)

    def grams(text):
        padded = f" {text.lower()} "
        out = np.zeros(dim)
        n = 0
        for i in range(len(padded) - 2):
            a, b, c = padded[i : i + 3]
            if b != " ":
                vector = lambda x: encoder.letter(encoder.number[ord(x)])
                out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
                n += 1
        return out, n

    want = {}
    for text, lang in train:
        vector, n = grams(text)
        want[lang] = want.get(lang, np.zeros(dim)) + vector / n
    df = spark.createDataFrame(train, "text string, lang string")
    for r in langid.prototypes(df, dim=dim).collect():
        np.testing.assert_allclose(np.array(r.vector) / 65536, want[r.lang], atol=1e-3)
    asked = "das of the"
    vector, _ = grams(asked)
    cosine = {k: vector @ v / np.linalg.norm(vector) / np.linalg.norm(v) for k, v in want.items()}
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)] + [(9, asked, None)], "doc_id long, text string, lang string")
    got = langid.identify(docs, F.lit(True), dim=dim).where("id = 9").first()
    best = max(cosine, key=cosine.get)
    assert (got.lang_pred, got.score) == (best, pytest.approx(cosine[best], abs=1e-4))


def test_repeats_go_on_until_the_recall_is_met(monkeypatch):
    assert decontaminate._repeats_needed(5, 800, 800, 0.4, 0.99) > 1024
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 512)
    with pytest.raises(ValueError, match="walks"):
        decontaminate._repeats_needed(5, 600, 600, 0.4, 0.99)
