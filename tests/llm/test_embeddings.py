"""Plans of the p-stable search, its recall on planted pairs, and awkward vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import embeddings


def test_agreement_is_that_of_projections():
    rng = np.random.default_rng(1)
    for cosine in (0.0, 0.5, 0.93, 0.99):
        a, b = np.array([1.0, 0.0]), np.array([cosine, math.sqrt(1 - cosine * cosine)])
        directions, shifts = rng.standard_normal((2, 200_000)), rng.uniform(0, embeddings.WIDTH, 200_000)
        same = np.floor((a @ directions + shifts) / embeddings.WIDTH) == np.floor((b @ directions + shifts) / embeddings.WIDTH)
        assert same.mean() == pytest.approx(embeddings.agreement(cosine), abs=0.005)
    assert embeddings.agreement(1.0) == 1.0


def test_plans_follow_the_vectors():
    plans = [embeddings.plan(10**n, 0.93) for n in range(1, 10)]
    assert plans[0] == plans[3] == embeddings.Plan(6, 9)
    tables = [p.tables for p in plans]
    assert tables == sorted(tables) and tables[-1] < 10 * (10**9 / 60_000) ** 0.25
    for n, p in enumerate(plans, 1):
        meet = embeddings.agreement(0.93) ** p.projections
        assert 1 - (1 - meet) ** p.tables >= 0.995 and 10**n * embeddings.agreement(0.0) ** p.projections <= embeddings.FAR


def test_signatures_lose_next_to_nothing():
    part = math.acos(0.93) / math.pi
    for bits in (64, 192):
        most = embeddings.most_apart(bits, 0.93)
        tail = [sum(math.comb(bits, k) * part**k * (1 - part) ** (bits - k) for k in range(least, bits + 1)) for least in (most + 1, most)]
        assert tail[0] <= embeddings.MISS < tail[1]
    assert embeddings.most_apart(64, 1.0) == 0 and embeddings.most_apart(64, -1.0) == 64


def planted(rng, pairs, dim, cosine):
    """Pairs of vectors of exactly that cosine, far from all others."""
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


def test_recall_at_the_threshold(spark):
    a, b = planted(np.random.default_rng(2), 1500, 64, 0.9305)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(a)] + [(10_000 + i, x.tolist(), i % 3) for i, x in enumerate(b)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(docs).collect()}
    hit = sum(found[10_000 + i][1] == i for i in range(1500))
    assert hit >= 0.99 * 1500 and all(n == (c != i or n) for i, (n, c) in found.items())


@pytest.mark.parametrize("block", [16, 4096])
def test_crowds_count_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "STRIP", 32)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    vectors = (centre + rng.standard_normal((150, 32)) * 0.05).astype(np.float32)
    rows = [(i, x.tolist(), "a") for i, x in enumerate(vectors)] + [(1000 + i, vectors[0].tolist(), "a") for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    found = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(table).collect()}
    assert set(found.values()) == {(189, 0)}


def test_awkward_vectors(spark):
    long = [float(i % 7 + 1) for i in range(20_000)]
    rows = [
        (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, -0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, 0.0], None),
        (7, [math.nan, 1.0], 1), (8, [0.0, 0.0], 1), (9, [1e300, 1e300], 1), (10, [5e-300, 5e-300], 1), (11, long, 2), (12, long, 2), (13, [-math.inf, 1.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    table = table.withColumns({c: F.lit("clash") for c in ("id", "key", "pool", "raw", "cell", "table", "class")})
    found = sorted(((r["id"], r["n_links"], r["component"]) for r in embeddings.near_duplicates(table).collect()), key=str)
    want = [(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 1, 11)] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 13)]
    assert found == sorted(want, key=str)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
