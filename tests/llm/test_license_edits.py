"""License templates with allowed words dropped or replaced."""

import itertools
import math
import random

import pytest

from barloom.llm import licenses


def variants(template):
    """Texts with one word that is not a name dropped or replaced, and with all allowed misses spread out."""
    words = [w for w, _, _ in licenses.words_of(template.text)]
    free = [i for i, w in enumerate(words) if w not in template.names]
    for i in free:
        yield " ".join(words[:i] + words[i + 1 :])
        yield " ".join([*words[:i], "zzz", *words[i + 1 :]])
    misses = len(words) - math.ceil(licenses.COVERAGE * len(words))
    for step in (3, 4):
        gone = set([i for i in free if i % step == step - 1][:misses])
        yield " ".join("zzz" if i in gone else w for i, w in enumerate(words))


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.name)
def test_allowed_edits_are_found(template):
    index = licenses.Index(licenses.TEMPLATES)
    lost = [x for x in variants(template) if template.license not in {f["license"] for f in licenses.scan(f"lead in. {x}. and more", index)}]
    assert not lost


def test_templates_without_names():
    plain = (licenses.Template("plain", "P", (), "one two three four five six seven eight nine ten"),)
    found = licenses.scan("one two zzz four five zzz seven eight nine ten", licenses.Index(plain))
    assert [x["matched"] for x in found] == [8]


INDEX = licenses.Index(licenses.TEMPLATES)
FILL = "lorem ipsum the a software of license and general version public conditions work under is use copy".split()


def bound(template, rng):
    """The template's words with as many of them replaced as may be, but for its names, among others."""
    words = [w for w, _, _ in licenses.words_of(template.text)]
    free = [i for i, w in enumerate(words) if w not in template.names]
    misses = min(len(free), len(words) - math.ceil(licenses.COVERAGE * len(words) - 1e-9))
    for i in rng.sample(free, misses):
        words[i] = f"zq{i}"
    fill = lambda k: [rng.choice(FILL) for _ in range(k)]
    return fill(rng.randint(0, 20)) + words + fill(rng.randint(0, 20))


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.name)
def test_recall_at_the_bound(template):
    rng = random.Random(template.name)
    texts = [" ".join(bound(template, rng)) for _ in range(40)]
    hit = sum(template.license in {f["license"] for f in licenses.scan(x, INDEX)} for x in texts)
    assert hit >= 0.95 * len(texts)


def matched(pattern, words):
    """Most words of the pattern matched in order."""
    best = [0] * (len(words) + 1)
    for word in pattern:
        now = [0]
        for j, other in enumerate(words):
            now.append(best[j] + 1 if word == other else max(best[j + 1], now[j]))
        best = now
    return best[-1]


def test_all_templates_against_brute_force():
    """Every template that matches a window of a text as a whole overlaps a finding, and every finding is true."""
    rng = random.Random(8)
    for n in range(40):
        words = [w for t in rng.sample(licenses.TEMPLATES, 3) for w in bound(t, rng)]
        text = " ".join(words)
        found = licenses.scan(text, INDEX)
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        for f in found:
            template = next(t for t in licenses.TEMPLATES if t.name == f["template"])
            pattern = [w for w, _, _ in licenses.words_of(template.text)]
            inside = text[f["first_char"] : f["last_char"] + 1].split()
            assert f["matched"] == matched(pattern, inside) >= licenses.COVERAGE * len(pattern)
            assert set(template.names) <= set(inside) and not set(template.refused) & set(inside)
        for template in rng.sample(licenses.TEMPLATES, 12):
            pattern = [w for w, _, _ in licenses.words_of(template.text)]
            for at in range(0, len(words) - len(pattern) + 1):
                window = words[at : at + len(pattern)]
                if not set(template.names) <= set(window) or set(template.refused) & set(words[max(0, at - 5) : at + len(pattern) + 5]):
                    continue
                if sum(a == b for a, b in zip(pattern, window, strict=True)) >= licenses.COVERAGE * len(pattern):
                    a, b = starts[at], starts[at + len(pattern)] - 2
                    assert any(f["first_char"] <= b and f["last_char"] >= a for f in found), (n, template.name)


def test_interval_choice_matches_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        found = []
        for k in range(rng.randint(0, 7)):
            a = rng.randrange(30)
            found.append({"first_char": a, "last_char": a + rng.randint(1, 12), "matched": rng.randint(1, 9), "coverage": rng.choice((0.8, 0.9, 1.0)), "template": str(k)})
        clear = [
            x for k in range(len(found) + 1) for x in itertools.combinations(found, k)
            if all(a["last_char"] < b["first_char"] or b["last_char"] < a["first_char"] for a, b in itertools.combinations(x, 2))
        ]
        value = lambda x: (sum(f["matched"] for f in x), round(sum(f["coverage"] for f in x), 6))
        kept = licenses.clear_of_each_other(found)
        assert value(kept) == max(map(value, clear))
        assert all(a["last_char"] < b["first_char"] for a, b in itertools.pairwise(kept))


@pytest.mark.parametrize(("text", "names"), [
    ("GNU General Public License, version 2", ["GPL-2.0"]), ("under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]), ("Licensed under the Apache License, Version 1.1.", []),
    ("Released under the MIT License. Licensed under CC BY-SA 4.0.", ["MIT", "CC-BY-SA-4.0"]), ("Not a license at all, version 2.", []),
])
def test_relatives_are_told_apart(text, names):
    assert [f["license"] for f in licenses.scan(text, INDEX)] == names
