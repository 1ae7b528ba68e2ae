"""The network's gradients against differences, its held-out accuracy, and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import entries, toxicity
from barloom.llm.toxicity import LONG, STRIDE, WINDOW, Network, Reader, score_toxicity, windows


def test_gradients_are_those_of_differences():
    words = ["alpha", "beta", "gamma", "delta", "omega", "unknown"]
    codes = np.unique(toxicity._grams(words[:5])[0])
    network = Network(words[:5], codes, 3)
    for k, v in network.p.items():
        network.p[k] = v.astype(np.float64)
    features = network.features(words)
    rows = np.array([[0, 1, 2, 5, 3], [4, 3, 0, -1, -1], [5, -1, -1, -1, -1]])
    targets, weights = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.25, 0.25])

    def loss():
        logit = network.forward(rows, network.projected(features))
        return (weights * (np.logaddexp(0, logit) - targets * logit)).sum()

    found = network.gradients(rows, features, targets, weights)
    rng = random.Random(1)
    for name, values in network.p.items():
        for _ in range(12):
            at = tuple(rng.randrange(n) for n in values.shape)
            if name in ("words", "grams") and at[0] == 0:
                continue
            held, eps = values[at], 1e-2 if name == "grams" else 1e-3
            values[at] = held + eps
            up = loss()
            values[at] = held - eps
            down = loss()
            values[at] = held
            assert found[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4), (name, at)


def test_windows_cover_and_overlap():
    for n in (1, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW + 7):
        found = windows(np.arange(n, dtype=np.int32))
        assert set(found[found >= 0].tolist()) == set(range(n))
        assert all((found[i, STRIDE:] == found[i + 1, : WINDOW - STRIDE]).all() for i in range(len(found) - 1))
        assert (found[-1] >= 0).any() and (len(found) == 1 or (found[-1] >= 0).sum() > WINDOW - STRIDE)


def invented(rng, n, toxic_share=0.3):
    """Labelled texts of syllables: label 1 has words of a small set or with a certain begin."""
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < toxic_share
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vex", "zorq", "quax" + word()]))
        rows.append((i, " ".join(text).capitalize() + ".", int(toxic)))
    return rows


def test_learns_words_and_begins(spark):
    rows = invented(random.Random(4), 1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("train", F.lit(0))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    plain = " ".join(r[1] for r in invented(random.Random(5), 200, 0.0))
    far = plain + " zorq vex zorq " + plain
    odd = [(9000, None), (9001, ""), (9002, " \n\t"), (None, "la zorq vex quaxla"), (9003, far), (9003, far), (9004, "x" * 100_000), (9005, plain)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    held = F.col("doc_id") % 4 == 2
    got = score_toxicity(more, labels, train=~held).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got}
    right = [(by[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows if i % 4 == 2]
    assert np.mean(right) > 0.93
    assert by[9000] == by[9001] == by[9002] == 0
    assert by[None] > 0.5 and by[9003] > 0.5 and by[9005] < 0.3


def test_whole_texts_are_read_alike():
    network = Network(["a", "b"], np.zeros(0, np.uint64), 1)
    texts = ["a b " * 50, None, "", "c" * 5 * LONG, "a b " * 50, "é" * (LONG + 1) + " b"]
    one = [Reader(network).logits([t])[0] for t in texts]
    np.testing.assert_allclose(Reader(network).logits(texts), one, atol=1e-5)
    assert one[1] == one[2] == -np.inf


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "doc_id long, text string")
    labels = "doc_id long, toxic int"
    score = lambda rows: {r.id: r.score for r in score_toxicity(docs, spark.createDataFrame(rows, labels)).collect()}
    assert score([]) == {1: 0, 2: 0, 3: 0}
    assert score([(1, None), (7, 1)]) == {1: 0, 2: 0, 3: 0}
    assert score([(1, 1), (1, 0), (None, 1)]) == {1: 1, 2: 0, 3: 0}
    assert score([(1, 0)]) == {1: 0, 2: 0, 3: 0}
    assert score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], labels)).collect() == []


def test_held_out_accuracy_of_query(spark):
    sf = "/root/testdata/sf0.1"
    got = entries.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = got.where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n[0, 0] / (n[0, 0] + n[0, 1]) > 0.97
