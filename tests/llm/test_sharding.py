"""Shards against a brute-force layout: balance, groups of equal texts, slots."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import sharding


def laid_out(spark, rows, shards):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "size", "shard", "slot", "at", "rank", "text_key")})
    found = sharding.shard(docs, shards).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert sorted((str(r["id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes, homes = defaultdict(list), [0] * shards, defaultdict(set)
    for r in found:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        homes[texts[r["id"]][0]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes, homes


@pytest.mark.parametrize("seed", range(3))
def test_groups_that_fit_stay_whole(spark, seed):
    rng = random.Random(seed)
    texts = [f"{i} " + "x" * rng.randint(0, 200) for i in range(1200)]
    for n in (700, 300, 60, 50, 9, 8, 7):  # from more than a shard to a small group
        texts += [f"group {n} " + "y" * 90] * n
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    shards = 8
    sizes, homes = laid_out(spark, rows, shards)
    target, bytes_of = sum(sizes) / shards, defaultdict(int)
    for _, t in rows:
        bytes_of[t] += len(t) + 16
    assert all(len(homes[t]) == 1 for t, n in bytes_of.items() if n <= target)
    assert len(homes["group 700 " + "y" * 90]) > 1
    assert max(sizes) <= 1.1 * target and min(sizes) >= 0.9 * target


def test_large_groups_alone(spark):
    """More groups of three fifths of a shard than shards: whole, as even as they can be."""
    rows = [(i, f"text {i % 12} " + "z" * 300) for i in range(12 * 25)]
    sizes, homes = laid_out(spark, rows, 8)
    assert all(len(x) == 1 for x in homes.values()) and len({t for _, t in rows}) == 12
    assert max(sizes) <= 2 * max(len(t) + 16 for _, t in rows) * 25


def test_levels():
    even = sharding._levelled([0, 0, 0, 0], 10)
    assert sum(even) == 10 and max(even) - min(even) <= 2
    assert sharding._levelled([9, 0, 3], 9) == [0, 6, 3]
    assert sharding._levelled([100, 0], 4) == [0, 4]


def test_few_and_no_rows(spark):
    assert sum(laid_out(spark, [(1, "a"), (None, None), (2, "")], 5)[0]) == 49
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 0)
