import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_roots(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"new{rng.randrange(1 << 30)}"
    return " ".join(out)


def corpus():
    """Families of copies edited so that their similarities lie on both sides of 0.8."""
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "one two", "one two three four five"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        texts += [" ".join(base)] * 2 + [edited(rng, base, k) for k in (1, 1, 2, 3) if k < len(base)]
        texts += [" ".join(base[: int(len(base) * s)]) for s in (0.97, 0.93, 0.7)] + [" ".join(["top", *base, "end"])]
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).selectExpr("*", "1 AS node", "2 AS n", "3 AS fps", "4 AS text_hash", "5 AS kind", "6 AS label")
    got = {}
    for r in simhash.near_copies(docs).collect():
        got.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for i, x in enumerate(slow_roots(texts)):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_stage_finds_what_lies_beyond_four_bits(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    label = slow_roots(texts)
    assert kept == {label.index(x) for x in set(label)}


@pytest.mark.parametrize("kind", ["tail", "head", "cut", "scattered"])
def test_fingerprints_meet_from_the_threshold_on(kind):
    """Of pairs in each band of similarity at least 97 of 100 are within the budget somewhere."""
    rng = random.Random(kind)
    word = lambda: f"w{rng.randrange(20_000)}"
    found = {}
    for _ in range(500):
        base = [word() for _ in range(rng.randint(60, 400))]
        n = int(len(base) * rng.uniform(0.03, 0.27))
        more = [word() for _ in range(n)]
        other = {"tail": base + more, "head": more + base, "cut": base[: len(base) - n], "scattered": edited(rng, base, 1 + n // 6).split()}[kind]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        alike = len(a & b) / len(a | b)
        if alike >= 0.8:
            prints = [simhash.prints_of(np.array([hash(p) & (1 << 64) - 1 for p in itertools.pairwise(w)], np.uint64)) for w in (base, other)]
            found.setdefault(int(alike * 20), []).append(np.bitwise_count(prints[0] ^ prints[1]).min() <= simhash.BUDGET)
    for band, hits in found.items():
        assert sum(hits) >= 0.97 * len(hits) - 1, (band, sum(hits), len(hits))


def test_odd_rows(spark):
    """Null ids, repeated rows, a very long text, and many texts of one template that are
    within the budget but not alike."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(9999)}" for _ in range(120_000))
    base = [f"t{i}" for i in range(60)]
    template = [edited(rng, base, 6) for _ in range(60)]
    texts = [long, f"{long} more", *template, base_text := " ".join(base), base_text]
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, long), (None, None), (None, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in simhash.near_copies(docs.withColumn("t", F.col("text")), keep=("t",)).collect():
        got.setdefault(r["root"], []).append((r["doc_id"], r["t"]))
    label = slow_roots([t for _, t in rows])
    want = {}
    for x, row in zip(label, rows, strict=True):
        want.setdefault(x, []).append(row)
    key = lambda groups: sorted(sorted(map(repr, g)) for g in groups.values())
    assert key(got) == key(want)


def test_empty_table(empty):
    assert simhash.near_copies(empty).count() == 0
