"""The corpus operators against brute force, round trips, and awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, components, decontaminate, embeddings, langid, licenses, lines, mixing, secret_scan, sharding, simhash
from barloom.llm.common import word_count

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
#: Column names that the operators use themselves.
CLASHES = ("id", "row", "key", "fp", "size", "line", "label", "rank", "at", "band", "held", "component", "value", "p", "copies")
AWKWARD = [
    (1, None, "en", "web"), (2, "", None, None), (3, "   \n\t ", "en", "web"), (4, "one", "en", ""), (5, "Alpha beta\ngamma delta", "de", "web"),
    (5, "Alpha beta\ngamma delta", "de", "web"), (None, "alpha BETA\ngamma delta", None, None), (7, "word " * 60_000, "en", "web"), (8, "x" * 300_000, "fr", "code"),
]
DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "a", "es", "um")) for _ in range(n))


def awkward(spark, rows=AWKWARD):
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def components_of(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("run", [1 << 18, 40])
def test_components_match_union_find(spark, monkeypatch, run):
    monkeypatch.setattr(components, "RUN", run)  # one task, and rounds over the cluster
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {x for link in links for x in link}
    assert {x: got.get(x, x) for x in nodes} == components_of(nodes, links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_count(spark):
    texts = ["", None, " ", "a", "a  b", " \ta\n\nb\x0b c\r\n", "a\x01 \x02b\x02\x01 c", "é à"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- 1 SimHash ----------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 400) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:4]:
        for _ in range(40):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = components_of(prints, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs).select("id", simhash.hex_digits(F.col("fp")), "component").collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}
    assert len(set(expected.values())) < len(rows)


def test_simhash_split_keys_find_the_same(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for x in list(prints)[:5]:
        prints |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    table = spark.createDataFrame(signed, "fp long")
    few = dict(components.connected_components(simhash.links(table, bucket=2)).collect())
    many = dict(components.connected_components(simhash.links(table, bucket=10_000)).collect())
    brute = components_of([x[0] for x in signed], [(a[0], b[0]) for a, b in itertools.combinations(signed, 2) if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2])
    assert few == many == {x: r for x, r in brute.items() if x != r}


def test_simhash_table_discards_far_pairs_only(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    close = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base]
    half = [x & 0xFFFFFFFF | rng.getrandbits(32) << 32 for x in base]  # these share a key with their bases
    rows = [(i, x - 2**64 if x >= 2**63 else x, kind) for kind, xs in (("base", base), ("close", close), ("half", half)) for i, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "i int, fp long, kind string").withColumns(dict(zip(simhash.TABLE, simhash.distances(F.col("fp")), strict=True)))
    stored = {(r["i"], r["kind"]): [r[c] >> at & 255 for c in simhash.TABLE for at in range(0, 64, 8)] for r in table.collect()}
    assert stored[0, "base"] == [(base[0] ^ x).bit_count() for x in simhash.references()]
    kept = table.where("kind = 'base'").alias("x").join(table.where("kind != 'base'").alias("y"), "i").where(simhash.near("x", "y"))
    counts = dict(kept.groupBy("y.kind").count().collect())
    far = sum((a ^ b).bit_count() > 2 for a, b in zip(base, half, strict=True))
    assert counts["close"] == 300 and far > 290 and counts.get("half", 0) <= 300 - far + 6


def test_simhash_awkward(spark):
    found = simhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    by = defaultdict(set)
    for r in found:
        by[r["id"]].add((r["fp"], r["component"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}  # no words: fingerprint zero
    assert len(by[5]) == 1 and by[5] == by[None]
    assert simhash.near_duplicates(awkward(spark, [])).count() == 0


# --- 2 lines ------------------------------------------------------------------------------


def brute_lines(rows, similarity=0.8):
    """Kept places by document, from all pairs of different lines."""
    places = {}
    for n, (doc, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.replace("\t", " ").replace("\r", " ").strip(" ").lower()
            if line:
                places.setdefault(line, (doc, n, pos))
    sets = {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in places}
    links = [(a, b) for a, b in itertools.combinations(places, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    root = components_of(places, links)
    first = {}
    for x, r in root.items():
        first[r] = min(first.get(r, places[x]), places[x])
    return set(first.values()), len(links)


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    pool = [prose(rng, rng.randint(3, 25)) for _ in range(60)]
    near = []
    for line in pool[:12]:
        for _ in range(25):  # a crowd of variants, more than one block needs
            words = line.split()
            words[rng.randrange(len(words))] += rng.choice("xyz")
            near.append(" ".join(words))
    every = pool + near + ["short", "shor", "a", "b"]
    rows = [(i, "\n".join(rng.choice(every) for _ in range(12))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = {(r["id"], p) for r in lines.kept_lines(docs).collect() for p in r["kept"]}
    expected, links = brute_lines(rows)
    assert links > 100
    assert kept == {(doc, pos) for doc, _, pos in expected}


def test_lines_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 4)
    test_lines_match_brute_force(spark)


def test_lines_awkward(spark):
    docs = awkward(spark)
    found = {(r["id"], r["n_lines"], tuple(r["kept"])) for r in lines.kept_lines(docs).collect()}
    assert (1, 0, ()) in found and (2, 1, (0,)) in found and (4, 1, (0,)) in found
    assert sum(len(k) for i, n, k in found if i in (5, None)) == 2  # the null id comes first and keeps both lines
    assert lines.kept_lines(docs).count() == len(AWKWARD)
    clean = lines.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == len(AWKWARD)
    assert lines.kept_lines(awkward(spark, [])).count() == 0


# --- 3 language ---------------------------------------------------------------------------

ALPHABETS = {"aa": "bdkmoa", "bb": "tsrlei", "cc": "ßüzöwn"}


def test_language_on_held_out_texts(spark):
    rng = random.Random(8)
    text = lambda chars: " ".join("".join(rng.choice(chars) for _ in range(rng.randint(2, 7))) for _ in range(30))
    rows = [(i, text(ALPHABETS[x]), x, None) for i, x in enumerate(rng.choice(sorted(ALPHABETS)) for _ in range(300))]
    docs = spark.createDataFrame(rows, DOCS)
    found = langid.identify(docs, train=F.col("doc_id") % 4 != 2, held=F.col("doc_id") % 4 == 2).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r["held"]]
    assert len(held) > 50 and all(truth[r["id"]] == r["lang_pred"] for r in held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_awkward(spark):
    docs = awkward(spark)
    found = langid.identify(docs, train=F.lit(True)).collect()
    assert len(found) == len(AWKWARD)
    assert {r["id"] for r in found if r["lang_pred"] == "und"} == {1, 2, 3}
    nothing = langid.identify(docs, train=F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.identify(awkward(spark, []), train=F.lit(True)).count() == 0


# --- 4 embeddings -------------------------------------------------------------------------


def test_embeddings_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = []
    for _ in range(40):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append((len(rows), [float(x) for x in centre + rng.standard_normal(16) * 0.16], int(rng.integers(2))))
    rows += [(len(rows) + i, v, 1) for i, v in enumerate(([0.0] * 16, None, [math.nan] * 16, [math.inf] + [1.0] * 15, rows[0][1], rows[0][1]))]
    rows.append((len(rows), rows[0][1], None))
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(math.isfinite(x) for x in v) and any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(v))
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.93]
    count = defaultdict(int)
    for pair in links:
        for x in pair:
            count[x] += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    found = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(table).collect()}
    assert len(found) == len(rows)
    got, want = sum(n for n, _ in found.values()), sum(count.values())
    assert want > 200 and 0.98 * want <= got <= want
    assert all(found[i][0] <= count[i] for i in found)
    assert all(found[i] == (0, i) for i in found if i not in unit)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# --- 5 licenses ---------------------------------------------------------------------------


def brute_alignment(template, text):
    """Longest common subsequence of the whole template and the whole text."""
    best = [0] * (len(text) + 1)
    for word in template:
        now = [0]
        for j, other in enumerate(text):
            now.append(best[j] + 1 if word == other else max(best[j + 1], now[j]))
        best = now
    return best[-1]


def test_licenses_found_with_spans(spark):
    rng = random.Random(10)
    rows, planted = [], {}
    for i in range(60):
        lead, tail = prose(rng, rng.randint(0, 40)), prose(rng, 30)
        if i % 2:
            t = rng.choice(licenses.TEMPLATES)
            words = t.text.split()
            if len(words) > 20:  # one word in fifteen changed
                for k in range(7, len(words), 15):
                    if not any(n in words[k].lower() for n in t.names):
                        words[k] = "altered"
            body = " ".join(words)
            rows.append((i, f"{lead} {body} {tail}"))
            planted[i] = (t.license, len(lead) + 1)
        else:
            rows.append((i, f"{lead} the license that applies is described below {tail}"))
    found = {r["id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == set(planted)
    for i, (name, start) in planted.items():
        assert found[i]["license"] == name and found[i]["first_char"] == start
        text = dict(rows)[i][found[i]["first_char"] : found[i]["last_char"] + 1]
        words = [w for w, _, _ in licenses.words_of(text)]
        template = next(t for t in licenses.TEMPLATES if t.name == found[i]["template"])
        assert found[i]["matched"] == brute_alignment([w for w, _, _ in licenses.words_of(template.text)], words)


def test_winnowing_keeps_one_of_every_window():
    rng = random.Random(11)
    hashes = [rng.randrange(50) for _ in range(200)]
    kept = set(licenses.winnow(hashes, 4))
    assert all(kept & set(range(i, i + 4)) for i in range(len(hashes) - 3))
    assert licenses.winnow([], 4) == [] and licenses.winnow([5], 4) == [0]


def test_licenses_awkward(spark):
    assert licenses.scan_licenses(awkward(spark)).count() == 0
    assert licenses.scan_licenses(awkward(spark, [])).count() == 0
    long = [(1, "word " * 300_000 + "Released under the MIT License. " * 2, None, None)] * 2
    found = licenses.scan_licenses(awkward(spark, long)).collect()
    assert len(found) == 4 and {r["license"] for r in found} == {"MIT"}


# --- 6 chat -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(12)
    parts = [*chat.CONTROLS, "\\", "\n", "plain", "<|im_", "start|>", "é", "\\<", ""]
    rows = [(c, t, rng.choice(("user", "assistant", "system", "odd\nrole")), "".join(rng.choice(parts) for _ in range(6))) for c in range(40) for t in range(4)]
    rows += [(99, 0, "user", None), (99, 1, None, "x"), (98, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    done = chat.format_turns(chat.canonical_turns(chat.rows_to_records(table)))
    back = done.select("id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    said = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        said[c].append((role or "", text or ""))
    for r in back.collect():
        assert [tuple(t) for t in r["turns"]] == said[r["id"]]
        assert r["loss"] == "".join(t for role, t in said[r["id"]] if role == "assistant")
        for control in chat.CONTROLS[2:]:
            assert control not in r["formatted"]
    assert chat.rows_to_records(table.limit(0)).count() == 0


def test_chat_layouts(spark):
    rows = spark.createDataFrame(
        [
            (1, "Add.", "1+1", "2", None, None, None, None), (2, "Say hi.", None, "hi", None, None, None, "be kind"),
            (3, None, None, None, "p", "c", None, None), (4, None, None, None, None, None, [("human", "q"), ("gpt", "a")], None), (5, None, None, None, None, None, None, None),
        ],
        "n long, instruction string, input string, output string, prompt string, completion string, conversations array<struct<`from`:string,value:string>>, system string",
    )
    found = {r["n"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(rows).collect()}
    assert found[1] == ("instruction", [("user", "Add.\n\n1+1"), ("assistant", "2")])
    assert found[2] == ("instruction", [("system", "be kind"), ("user", "Say hi."), ("assistant", "hi")])
    assert found[3] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert found[4] == ("exchanges", [("user", "q"), ("assistant", "a")])
    assert found[5] == (None, [])


# --- 7 mixing -----------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * share, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over
        if len(capped) == len(names):
            return {s: most * sizes[s] for s in names}


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.choice((1, 3, 10, 40, 200))), None, rng.choice(("a", "a", "a", "b", "c", "Z", None))) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r["id"], r["copies"]) for r in found} == {(r["id"], r["copies"]) for r in again}
    assert len(found) == len(rows) and max(r["copies"] for r in found) <= 2
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = brute_targets(dict(sizes))
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mixing_awkward(spark):
    found = mixing.mix(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    assert all(r["copies"] == 0 for r in found if r["size"] == 0)
    assert mixing.mix(awkward(spark, [])).count() == 0


# --- 8 secrets ----------------------------------------------------------------------------


def test_secrets_on_held_out_findings(spark):
    known = secret_scan.example_findings(spark, 2400).cache()
    held = F.crc32("text") % 4 == 0
    model = secret_scan.train(known.where(~held))
    rows = secret_scan._described(known.where(held), "text", ()).select("first_char", "secret", F.explode("held").alias("x")).where("x.first_char = first_char")
    from pyspark.ml.functions import array_to_vector

    judged = model.transform(rows.select(F.col("secret").cast("double").alias("label"), array_to_vector("x.features").alias("features"))).select("label", "prediction").collect()
    assert len(judged) > 300
    assert sum(r["label"] == r["prediction"] for r in judged) / len(judged) > 0.93


def test_secrets_in_texts(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [(1, f'lead token = "{hexes}" tail'), (2, f"see commit {hexes} for this"), (3, "nothing here"), (4, None), (5, ""), (1, f'lead token = "{hexes}" tail')]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("value", F.lit("clash"))
    found = secret_scan.scan_secrets(docs, secret_scan.example_findings(spark)).collect()
    assert [(r["id"], r["first_char"], r["value"]) for r in found] == [(1, 14, hexes)] * 2
    labelled = spark.createDataFrame([], "text string, first_char long, secret boolean")
    assert secret_scan.scan_secrets(docs, labelled).count() == 3  # no model: every candidate stays
    assert secret_scan.scan_secrets(awkward(spark, []), labelled).count() == 0
    assert secret_scan.scan_secrets(awkward(spark), labelled).select("id").collect() == [(8,)]


# --- 9 sharding ---------------------------------------------------------------------------


def test_shards_are_balanced_and_gapless(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(0, 60)), None, None) for i in range(1500)] + [(2000 + i, "same text", None, None) for i in range(400)]
    found = sharding.shard(spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("clash")), 12).collect()
    text = {r[0]: r[1] for r in rows}
    sums, slots = defaultdict(int), defaultdict(list)
    for r in found:
        raw = text[r["id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sums.values()) / 12
    assert sorted(sums) == list(range(12)) and all(abs(x - mean) < mean * 0.15 for x in sums.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_awkward(spark):
    found = sharding.shard(awkward(spark), 4).collect()
    assert len(found) == len(AWKWARD) and {r["shard"] for r in found} <= set(range(4))
    assert sharding.shard(awkward(spark, []), 4).count() == 0


# --- 10 decontamination -------------------------------------------------------------------


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(15)
    items = [(k, prose(rng, rng.randint(8, 30))) for k in range(25)] + [(25, "three short ones"), (26, "labore"), (91, None), (92, "--")]
    rows = []
    for i in range(120):
        text = prose(rng, 60).split()
        if i % 2:
            words = items[25 if i % 20 == 1 else rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, len(words) // 5 + 1) if len(words) > 3 else 0):
                words[rng.randrange(len(words))] = "other"
            text[20:20] = words
        rows.append((i, " ".join(text)))
    want = {
        (i, k) for i, text in rows for k, item in items[:27]
        if best_edits(item.split(), text.split()) <= (len(item.split()) * 2) // 10
    }
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["id"], r["item_id"]) for r in found}
    assert len(want) > 100 and {k for _, k in want} >= {25, 26} and got <= want and len(got) >= 0.97 * len(want)
    for r in found:
        part = dict(rows)[r["id"]].split()[r["first_word"] : r["last_word"] + 1]
        assert word_edits(dict(items)[r["item_id"]].split(), part) == r["edits"]


def test_decontamination_awkward(spark):
    items = spark.createDataFrame([(1, "word word word word word"), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.find_leaks(awkward(spark), items).collect()
    assert {(r["id"], r["item_id"]) for r in found} == {(7, 1)}
    assert decontaminate.find_leaks(awkward(spark, []), items).count() == 0
    assert decontaminate.find_leaks(awkward(spark), items.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(16)
    item = prose(rng, 20)
    texts = [prose(rng, 120) for _ in range(60)]
    rows = [(i, t, "en", rng.choice("ab"), len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "a", 0) for i in range(5)]  # copies
    rows += [(200, prose(rng, 40) + " " + item + " " + prose(rng, 40), "en", "a", 0), (201, None, "en", "a", 0), (202, "123 456", None, "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    assert kept["language"] == sorted({r[0] for r in rows} - {201, 202})
    assert kept["near_duplicates"] == sorted(set(range(60)) | {200})
    assert kept["leaks"] == list(range(60))
    assert set(kept["weights"]) <= set(range(60)) and max(map(kept["weights"].count, kept["weights"])) <= 2
    assert kept["shards"] == kept["weights"]
    assert docs.columns == [*pipeline.COLUMNS, "shard", "slot"]
    again = pipeline.run(spark, str(tmp_path))
    assert sorted(r[0] for r in again.select("doc_id").collect()) == kept["shards"]
