"""Whitening against exact fractions and numpy, and awkward vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import entries, whitening

FORM = "vec_id long, embedding array<double>"


def plain_version(vectors):
    """(n, sums, exact total, eigenvalues, eigenvectors) of the different vectors, from the covariance in full."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    total = sum((n * c - s) ** 2 for v in x for c, s in zip(v, sums, strict=True))
    d = len(sums)
    exact = [[sum(Fraction(n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x) / n**3 for j in range(d)] for i in range(d)]
    values, basis = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
    return n, sums, total, values[::-1], basis[:, ::-1]


def check(got, vectors, most=4):
    rows, fit, error = got
    n, sums, total, values, basis = plain_version([v for _, v in vectors])
    assert (fit.n, fit.sums, fit.total) == (n, sums, total)
    k = len(fit.variances)
    assert k == min(most, int((values > 1e-10 * values[0]).sum()))
    np.testing.assert_allclose(fit.variances, values[:k], rtol=1e-9)
    np.testing.assert_allclose(np.abs((fit.components * basis[:, :k]).sum(0)), 1, atol=1e-9)
    np.testing.assert_allclose(fit.explained, values[:k] / values.sum(), rtol=1e-9)
    assert error < 1e-6
    found = {}
    for r in rows.collect():
        found.setdefault(r.id, []).append(r)
    assert sum(map(len, found.values())) == len(vectors)
    for i, v in vectors:
        x = [math.floor(256 * c) for c in v]
        r = found[i][0]
        assert (r.n, int(r.deviation)) == (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)))
        want = (np.array(x) - np.array(sums) / n) @ fit.components / np.sqrt(fit.variances)
        np.testing.assert_allclose(r.whitened, want, atol=1e-9)


def test_equals_exact_covariance(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 6)) @ rng.standard_normal((6, 6)) / 4
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(1000 + i, base[7].tolist()) for i in range(300)]  # a crowd of copies
    table = spark.createDataFrame(vectors, FORM).withColumn("x", F.lit("clash")).withColumn("n", F.lit(3)).withColumn("w", F.lit(1))
    check(whitening.whiten(table.repartition(5)), vectors)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 1.0]), (2, [0.1, 0.2, 0.3]), (3, [0.5, -0.25, 1.0]), (4, [-1.0, 0.0, 3.0]), (None, [2.0, 2.0, 2.0])]
    bad = [(10, None), (11, []), (12, [1.0, None, 1.0]), (13, [nan, 1.0, 1.0]), (14, [inf, 1.0, 1.0]), (15, [1.0, 2.0])]
    rows, fit, _ = whitening.whiten(spark.createDataFrame(good + bad, FORM))
    assert sorted((r.id is None, r.id or 0) for r in rows.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert fit.n == 4 and len(fit.variances) == 3


def test_few_directions(spark):
    line = [(i, [0.25 * i, -0.5 * i, 1.0]) for i in range(5)]
    check(whitening.whiten(spark.createDataFrame(line, FORM)), line)
    rows, fit, error = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], FORM))
    assert (fit.n, len(fit.variances), error) == (1, 0, 0.0)
    assert [(r.whitened, int(r.deviation)) for r in rows.collect()] == [([], 0)] * 4
    rows, fit, error = whitening.whiten(spark.createDataFrame([], FORM))
    assert rows.collect() == [] and fit is None
    assert rows.columns == ["id", "n", "deviation", "whitened"]


def test_large_entries_stay_exact(spark):
    vectors = [(i, [float(2**40 + i * i), -float(i) * 2**33]) for i in range(6)]
    check(whitening.whiten(spark.createDataFrame(vectors, FORM)), vectors)
    rows, _, _ = whitening.whiten(spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0])], FORM))
    assert [r.id for r in rows.collect()] == [0, 1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, sums, total, values, basis = plain_version([r.embedding for r in table])
    got = entries.op11_whitening(spark, sf).collect()
    assert len(got) == 4 * len(table)
    vectors = {r.vec_id: np.array([math.floor(256 * c) for c in r.embedding]) for r in table}
    signs = {}
    for r in got:
        x, c = vectors[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = (x - np.array(sums) / n) @ basis[:, c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-6) and r.identity_error < 1e-6
