"""Sketches, packed bands and crowds of the candidate verification."""

import random

import numpy as np

from barloom.llm import lines, verify


def test_sketches_keep_similar_lines():
    """Lines at the threshold have alike sketches, unrelated long ones have not."""
    rng = random.Random(1)
    signer = lines.Signer(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    near = far = 0
    for size in (8, 20, 60, 200, 800):
        for _ in range(60):
            a = "".join(rng.choice(letters) for _ in range(size))
            b = list(a)
            while verify.jaccard(lines.shingles(a), lines.shingles("".join(b))) > 0.82:
                last = list(b)
                b[rng.randrange(size)] = "#"
            b = "".join(b if verify.jaccard(lines.shingles(a), lines.shingles("".join(b))) >= 0.8 else last) if a != "".join(b) else a
            c = "".join(rng.choice(letters) for _ in range(size))
            s = signer.signatures([a, b, c])[1]
            near += bool(verify.alike(s[0:1], s[1:2], 0.8)[0])
            far += size >= 60 and bool(verify.alike(s[0:1], s[2:3], 0.8)[0])
    assert near == 300 and far == 0


def test_crowds_and_packed_pairs(spark, monkeypatch):
    """Every id of a shared band comes with a centre of that band, however the ids are dealt out."""
    rng = random.Random(2)
    rows = [(i, [rng.randrange(40), 1000 + rng.randrange(3000), 7]) for i in range(600)]
    rows += rows[:50]
    for run in (64, 1 << 19):
        monkeypatch.setattr(verify, "RUN", run)
        found = verify.grouped(spark.createDataFrame(rows, "id long, bands array<long>"), 3).collect()
        members = {}
        for i, bands in rows:
            for b in bands:
                members.setdefault(b, set()).add(i)
        shared = {b: x for b, x in members.items() if len(x) > 1}
        got, centres = {}, {}
        for r in found:
            got.setdefault(r["band"], set()).add(r["id"])
            centres.setdefault(r["band"], set()).add(r["centre"])
        assert got == shared and all(centres[b] <= shared[b] for b in shared)


def test_blocks_stay_whole():
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted(rng.randrange(9) for _ in range(200))
    table = pa.RecordBatch.from_pydict({"band": keys, "low": [0] * 200, "high": [0] * 200, "x": list(range(200))})
    cuts = [0, 1, 50, 51, 130, 200]
    parts = list(verify.whole_blocks(iter([table.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])))
    assert [x for rows, _ in parts for x in rows.column("x").to_pylist()] == list(range(200))
    found = [tuple(rows.column("band").to_pylist()[a:b]) for rows, s in parts for a, b in zip(s, np.append(s[1:], rows.num_rows), strict=True)]
    assert all(len(set(x)) == 1 for x in found) and len(found) == len(set(keys))
