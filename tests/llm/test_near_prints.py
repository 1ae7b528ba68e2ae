"""The near-copy search's fingerprints, pivot tables and clusters of keys."""

import itertools
import random

import numpy as np

from barloom.llm import near_copies
from barloom.llm.verify import Hashes


def pairs(rng, size, count=150):
    """Shingle sets of about that size at a Jaccard of 0.8 or little more."""
    for _ in range(count):
        shared = int(np.ceil(0.8 * size))
        values = rng.integers(0, 2**63, size, dtype=np.uint64)
        own = (size - shared) // 2
        yield Hashes.of(values[: shared + own]), Hashes.of(np.append(values[:shared], values[shared + own :]))


def test_pairs_at_the_threshold_share_a_key_and_stay():
    rng, signer = np.random.default_rng(5), near_copies.Signer(0.8)
    for size in (5, 10, 60, 700):
        met = kept = 0
        for a, b in pairs(rng, size):
            prints = [signer.fingerprint(x) for x in (a, b)]
            keys = [np.frombuffer(x, "<u2") for x in prints]
            heads = [np.frombuffer(x[: near_copies.HEAD // 8], np.uint64) for x in prints]
            met += bool((keys[0] == keys[1]).any()) and int(np.bitwise_count(heads[0] ^ heads[1]).sum()) <= signer.head
            x, y = (np.frombuffer(d.tobytes() + p, np.uint8)[None] for d, p in zip(signer.distances(prints), prints, strict=True))
            kept += bool(signer.near(x, y)[0])
        assert met >= 148 and kept == 150


def test_stored_distances_discard_unlike_sets():
    """Nearly all pairs of unlike texts are discarded by the distances to the pivots alone."""
    rng, signer = np.random.default_rng(6), near_copies.Signer(0.8)
    prints = [signer.fingerprint(Hashes.of(rng.integers(0, 2**63, 300, dtype=np.uint64))) for _ in range(200)]
    table = signer.distances(prints).view(np.uint8)
    left, right = (np.array(x) for x in zip(*itertools.combinations(range(200), 2), strict=True))
    assert signer.discarded(table[left], table[right]).mean() > 0.98


def test_clusters_match_all_pairs(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(near_copies, "CROWD", 20)
    rows, base = [], [rng.getrandbits(128) for _ in range(40)]
    for i in range(700):
        crowd = i % 3
        fp = base[0] if crowd == 0 else base[rng.randrange(40)]
        for _ in range(rng.randrange(30)):
            fp ^= 1 << rng.randrange(128)
        rows.append((0 if crowd == 0 else rng.randrange(6), i, [fp & (2**64 - 1), fp >> 64]))
    records = np.array([(k, i, tuple(h)) for k, i, h in rows], near_copies._RECORD)
    found, label = near_copies.clusters(records, 39, most=500)
    got = {}
    for i, x in zip(found["id"].tolist(), label.tolist(), strict=True):
        got.setdefault(x, set()).add(i)
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (k, i, x), (m, j, y) in itertools.combinations(rows, 2):
        if k == m and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= 39:
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i in range(700):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_very_small_sets_have_no_near_ones():
    signer = near_copies.Signer(0.8)
    assert [signer.alone(Hashes.of(np.arange(n, dtype=np.uint64))) for n in (0, 1, 3, 4, 5)] == [True, True, True, False, False]
