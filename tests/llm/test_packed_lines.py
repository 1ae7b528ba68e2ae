"""Lines whose bands come packed, and pairs of components whose shingles are made many at once."""

import random

import numpy as np
import pyarrow as pa

from barloom.llm import lines, verify


def _never(text):
    raise AssertionError("a text was cut alone")


def test_packed_bands_as_arrays(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-50, 50), rng.randrange(-(2**63), 2**63)]) for i in range(300)]
    packed = [(i, np.array(x, np.int64).tobytes()) for i, x in rows]
    met = [
        {(r["band"], r["id"], r["centre"], r["open"]) for r in verify.grouped(spark.createDataFrame(x, f"id long, bands {kind}").coalesce(1), 2).collect()}
        for x, kind in ((rows, "array<long>"), (packed, "binary"))
    ]
    assert met[0] == met[1] and len({i for _, i, _, _ in met[0]}) > 200


def test_each_id_once():
    """Rows of an id that are cut into several batches give its different centres and open bands."""
    rng = random.Random(9)
    rows = sorted((rng.randrange(20), rng.randrange(5), rng.randrange(8), rng.random() < 0.5) for _ in range(400))
    table = pa.RecordBatch.from_pylist([dict(zip(("id", "centre", "band", "open"), x, strict=True)) for x in rows])
    for size in (1, 7, 400):
        found = [r for b in verify._by_id(table.slice(a, size) for a in range(0, 400, size)) for r in b.to_pylist()]
        assert [r["id"] for r in found] == sorted({x[0] for x in rows})
        for r in found:
            assert r["centres"] == sorted({c for i, c, _, _ in rows if i == r["id"]})
            assert r["bands"] == sorted({b for i, _, b, is_open in rows if i == r["id"] and is_open})


def test_components_are_joined_from_shingles_cut_together(monkeypatch):
    """As many links as the sets of one text after the other give; no text is cut alone, and sizes alone rule pairs out."""
    rng = random.Random(10)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150, 300))) for _ in range(12)]
    texts = [x[:i] + "#" + x[i + 1 :] for x in bases for i in (3, 11, 20)] + [x + x[::-1] for x in bases]
    places = np.zeros(len(texts), verify._PLACE)
    places["id"] = places["root"] = np.arange(len(texts))
    rows = [{"part": 0, "places": places[i : i + 1].tobytes(), "id": i, "root": i, "sketch": bytes(80), "line": x} for i, x in enumerate(texts)]
    batch, tested, plain = pa.RecordBatch.from_pylist(rows), [], verify.jaccard
    monkeypatch.setattr(verify, "jaccard", lambda a, b: tested.append(min(len(a), len(b)) / max(len(a), len(b))) or plain(a, b))

    def links(cut, cuts):
        return [r for b in verify._joined(iter([batch]), cut, 0.8, lambda a, b: np.ones(len(a), bool), cuts) for r in b.to_pylist()]

    many, alone = links(_never, lines.all_shingles), links(lines.shingles, None)
    assert many == alone and len(many) >= 12
    assert min(tested) >= 0.8
