import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import licenses as lic


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=16), st.integers(-3, 3), st.integers(0, 4))
def test_alignment_equals_full_table(a, b, diagonal, band):
    pairs = lic.align(np.array(a, np.uint64), np.array(b, np.uint64), diagonal, band)
    assert all(a[i] == b[j] and abs(j - i - diagonal) <= band for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                ok = a[i - 1] == b[j - 1] and abs(j - i - diagonal) <= band
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + ok)
            else:
                best[i, j] = 0
    assert len(pairs) == best[len(a), len(b)]


def test_spans(spark, empty):
    mit = lic.TEMPLATES["MIT"]
    words = mit.split()
    edited = " ".join(words[:20] + ["INSERTED", "words"] + words[20:50] + words[53:])
    texts = [None, "", "ünïcode Released under the MIT License. end", f"// {mit.upper()}\n", edited, " ".join(words[: len(words) // 2]), "Released under\n\tthe  MIT License; Released under the MIT License", "all rights (reserved)", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string").selectExpr("*", "1 AS template", "2 AS start")
    got = {}
    for r in lic.matches(docs).collect():
        got.setdefault((r["doc_id"], r["template"]), []).append(r)
    line = got[2, "MIT-line"]
    assert len(line) == 2
    assert texts[2][line[0]["start"] : line[0]["stop"]] == "Released under the MIT License"
    assert got[3, "MIT"][0]["coverage"] == 1
    assert 0.95 < got[4, "MIT"][0]["coverage"] < 1
    assert (5, "MIT") not in got
    assert len(got[6, "MIT-line"]) == 2
    assert [(k, len(v)) for k, v in got.items() if k[0] == 7] == [((7, "Proprietary"), 1)]
    assert {k[0] for k in got} == {2, 3, 4, 6, 7}
    assert lic.matches(empty).count() == 0


def test_every_template_is_found_alone(spark):
    docs = spark.createDataFrame(list(enumerate(f"x {t} y" for t in lic.TEMPLATES.values())), "doc_id long, text string")
    full = {(r["doc_id"], r["template"]) for r in lic.matches(docs).where("coverage = 1").collect()}
    assert full >= set(enumerate(lic.TEMPLATES))


def test_the_best_of_overlapping_templates(spark):
    t = lic.TEMPLATES
    texts = [t["Apache-2.0"], t["BSD-3-Clause"], t["AGPL-3.0"], t["GPL-2.0"], "Licensed under CC BY-NC 4.0.", "# SPDX-License-Identifier: GPL-2.0-only", "Released under the Foo License.", "Released under an MIT License", t["GPL-3.0"].replace("version 3", "version 9")]
    got = {}
    for r in lic.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["template"])
    assert got == {0: ["Apache-2.0"], 1: ["BSD-3-Clause"], 2: ["AGPL-3.0"], 3: ["GPL-2.0"], 4: ["CC-BY-NC-4.0"], 5: ["SPDX-GPL-2.0-only"]}


def bare(text):
    words = (w.strip("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
    return [w for w in words if w]


def longest(a, b, diagonal, band):
    """A longest common subsequence near the diagonal, as its pairs; leftmost as in align."""
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    return lic.align(np.array([code[w] for w in a], np.uint64), np.array([code[w] for w in b], np.uint64), diagonal, band)


def slow(text, templates, k=3, window=4, band=8, coverage=0.8):
    """All runs of all templates against all runs of the text, and every alignment on a
    diagonal where two are equal."""
    words, naming, kept = bare(text), set(bare(lic.NAMING)), []
    hits = set()
    for name, body in templates.items():
        own = bare(body)
        size = min(k, len(own))
        hits |= {(name, d) for d in range(-len(own), len(words)) for i in range(len(own) - size + 1) if i + d >= 0 and own[i : i + size] == words[i + d : i + d + size]}
    while True:
        found = []
        for name, diagonal in hits:
            own, low = bare(templates[name]), max(0, diagonal - band)
            pairs = longest(own, words[low : max(low, diagonal + len(own) + band)], diagonal - low, band)
            if pairs and len(pairs) >= coverage * len(own) and {i for i, w in enumerate(own) if w in naming} <= {i for i, _ in pairs}:
                first, last = low + pairs[0][1], low + pairs[-1][1]
                if None not in words[first : last + 1]:
                    found.append((-len(pairs), -len(pairs) / len(own), first, last, list(templates).index(name), diagonal, name))
        if not found:
            return sorted(kept)
        m, c, first, last, *_, name = min(found)
        kept.append((name, -m, -c))
        words[first : last + 1] = [None] * (last + 1 - first)


def test_matches_equal_brute_force(spark):
    """Templates of four windows or less, of which the index has every run."""
    short = {n: t for n, t in lic.TEMPLATES.items() if len(bare(t)) <= 18}
    rng, texts = random.Random(5), []
    for _ in range(60):
        words = []
        for name in rng.sample(list(short), rng.randint(0, 3)):
            own = short[name].split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.sample(["the", "License", "new", "x1"], rng.randint(0, 2))
            words += [rng.choice(["under", "the", "filler", "License", "4.0"]) for _ in range(rng.randint(0, 6))] + own
        texts.append(" ".join(words))
    got = {i: [] for i in range(len(texts))}
    for r in lic.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=short).collect():
        got[r["doc_id"]].append((r["template"], r["matched_words"], r["coverage"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: slow(t, short) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 40
