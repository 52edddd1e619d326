import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows):
    words = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((w, gone))
    return out


def digested(rows):
    want = []
    for r, (w, gone) in zip(rows, removed(rows), strict=True):
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(repr, want))


@pytest.mark.parametrize(("common", "block", "slice_bytes", "piece"), [(4_000, 1 << 20, 8 << 20, 256), (1, 1 << 20, 8 << 20, 256), (4_000, 1, 1, 256), (6, 200, 2000, 5)])
def test_digests_equal_brute_force(docs, rows, monkeypatch, common, block, slice_bytes, piece):
    """Also with common anchors dealt out by whole windows, with blocks of single anchors,
    with slices of single texts, and with short pieces."""
    monkeypatch.setattr(substring, "_SLICE", slice_bytes)
    monkeypatch.setattr(substring, "PIECE", piece)
    got = substring.digests(docs, substring.factors(docs, common=common, block_words=block)).collect()
    assert sorted(map(repr, map(tuple, got))) == digested(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_factors_are_longest_matches_and_cover_every_repeated_window(texts, window):
    """At each place the longest match anywhere else, and every window that starts twice."""
    flat, first = [], []
    for k, t in enumerate(texts):
        first.append(len(flat))
        flat += [*t, 100 + k]
    ids, first = np.array(flat), np.array(first)
    stop = first + np.array([len(t) for t in texts])
    match = lambda i, j: next((n for n in range(len(flat)) if i + n >= len(flat) or j + n >= len(flat) or flat[i + n] != flat[j + n]), 0)
    length, source = substring.longest_matches(ids)
    for i in range(len(flat)):
        best = max((match(i, j) for j in range(len(flat)) if j != i), default=0)
        assert length[i] == best
        assert best == 0 or (source[i] != i and match(i, int(source[i])) == best)
    covered = set()
    for k, a, z, s in substring.parsed(ids, first, stop, window):
        assert z - a == length[a] >= window and first[k] <= a and z <= stop[k] and flat[a:z] == flat[s : s + z - a]
        covered |= set(range(a, z))
    count = Counter(tuple(flat[i : i + window]) for i in range(len(flat) - window + 1))
    want = {i + d for i in range(len(flat) - window + 1) if count[tuple(flat[i : i + window])] > 1 for d in range(window)}
    assert covered == want


def test_random_corpora_equal_brute_force(spark):
    """Periodic texts, shifted copies, passages that repeat within a text and across texts."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(4)
            a = rng.randrange(360)
            words += base[a : a + rng.randint(20, 90)] if kind < 2 else [rng.choice("abc")] * rng.randint(1, 60) if kind == 2 else ["x", "y", "z"] * rng.randint(1, 30)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (4_000, 3):
        got = substring.digests(docs, substring.factors(docs, common=common)).collect()
        assert sorted(map(repr, map(tuple, got))) == digested(rows)


def test_factors_point_at_equal_words(docs, rows):
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    found = substring.factors(docs).collect()
    assert found
    for f in found:
        n = f["stop"] - f["start"]
        assert n >= 35
        mine = [w[f["start"] : f["stop"]] for w in texts[f["doc_id"]]]
        other = [w[f["source_start"] : f["source_start"] + n] for w in texts[f["source_id"]]]
        assert any(a == b and len(a) == n for a in mine for b in other)


def test_cut_texts(docs, rows):
    got = substring.without_factors(docs, substring.factors(docs))
    assert got.columns == docs.columns
    assert got.count() == len(rows)
    want = sorted(repr((r[0], [x for x, y in zip(w, g, strict=True) if not y])) for r, (w, g) in zip(rows, removed(rows), strict=True))
    assert sorted(repr((r["doc_id"], WORD.findall(r["text"] or ""))) for r in got.collect()) == want
    untouched = {r[1] for r, (_, g) in zip(rows, removed(rows), strict=True) if not any(g)}
    assert untouched <= {r["text"] for r in got.collect()}


def test_empty_table(empty):
    found = substring.factors(empty)
    assert found.count() == 0
    assert substring.digests(empty, found).count() == 0


def test_columns_of_any_name_stay(docs, rows):
    odd = docs.selectExpr("*", "'a' AS of_id", "'b' AS of_key", "'c' AS spans_", "'d' AS __spans", "'e' AS __id", "'f' AS __key")
    got = substring.without_factors(odd, substring.factors(odd))
    assert got.columns == odd.columns and got.count() == len(rows)
    assert {tuple(r)[-6:] for r in got.collect()} == {("a", "b", "c", "d", "e", "f")}
