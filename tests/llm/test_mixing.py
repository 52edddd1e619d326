import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess over the cap is reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, out = set(), sum(sizes.values()), {}
    while len(full) < len(names):
        share = left / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and share * weight[s] >= most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in names if s not in full}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        full |= set(over)
    return out


def rows_of(seed, n, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < hot else rng.choice(["a", "b", "Ω", "\U0001f600", "￿", None])
        out.append((i, "wort " * int(rng.lognormvariate(4, 1.2)), source))
    out += [(n, "x " * 30_000, "long"), (n + 1, "y " * 40, "long"), (n + 2, "z " * 90, "long"), (n + 3, None, "void"), (n + 4, " \n\t", None), (n + 5, "", "a")]
    return out + [out[3], out[3], out[3], (None, "no id", "b"), (None, "no id", "b")]


@pytest.fixture(scope="module")
def mix(spark):
    rows = rows_of(1, 3000)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS class", "'l' AS lot", "3 AS n", "'o' AS of", "4 AS rank").repartition(5)
    return rows, df, mixing.mixed(df).collect()


def test_sizes_and_targets(mix):
    rows, _, got = mix
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    assert sorted(map(repr, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(repr, ((i, s, count(t)) for i, t, s in rows)))
    want = brute_targets(sizes)
    assert {r["source"] for r in got} == set(want)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)


def test_words_taken(mix):
    _, _, got = mix
    taken, target = {}, {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert abs(taken.pop("long") - target.pop("long")) <= 15_000  # half its longest document
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.01, abs=1), s


def test_reruns_agree(mix, spark):
    _, df, got = mix
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert key(mixing.mixed(df.repartition(2)).collect()) == key(got)
    assert key(mixing.mixed(df, seed=1).collect()) != key(got)


def test_orders_decide(spark, monkeypatch):
    """Of each class the n least orders are taken, also where one cell holds many and where
    class tables are joined without a broadcast."""
    rows = rows_of(2, 1500, hot=0.9)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for cells, most in ((4096, 50_000), (1, 0)):
        monkeypatch.setattr(mixing, "CELLS", cells)
        monkeypatch.setattr(mixing, "BROADCAST_CLASSES", most)
        got = sorted((repr(tuple(r)) for r in mixing.mixed(df).collect()))
        want = want or got
        assert got == want
    sized = mixing.sized(df).withColumn("class", mixing.size_class(F.col("size")))
    classes = {(r["source"], r["class"]): r for r in mixing.allotments(sized, mixing.targets(sized)).collect()}
    groups = {}
    for r in sized.where("size > 0").collect():
        c = classes[r["source"], r["class"]]
        p, u = min(1, max(0, c["height"] + c["tilt"] * (r["size"] - c["mean"]))), (int(r["lot"][:13], 16) + 0.5) / 2**52
        groups.setdefault((r["source"], r["class"]), []).append((u * (1 - p) / ((1 - u) * p) if p else float("inf"), r["lot"], r["doc_id"], r["size"]))
    brute = []
    for key, docs in groups.items():
        brute += [(i, size * (classes[key]["copies"] + (k < classes[key]["n"]))) for k, (*_, i, size) in enumerate(sorted(docs, key=lambda x: x[:2]))]
        assert len(docs) == classes[key]["docs"]
    brute += [(r["doc_id"], 0) for r in sized.where("size = 0").collect()]
    assert sorted(map(repr, brute)) == sorted(map(repr, ((r["doc_id"], r["taken"]) for r in mixing.mixed(df).collect())))


def test_every_document_has_its_chance(spark):
    """Over many seeds a document's mean copies are its source's target over its size."""
    rows = [(i, "w " * (20 + i), "ab"[i % 2]) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    seen = {}
    for seed in range(6):
        for r in mixing.mixed(df, weights=(1, 4), seed=seed).collect():
            seen.setdefault((r["source"], r["target"] / r["source_size"]), []).append(r["copies"])
    for (_, rate), copies in seen.items():
        assert sum(copies) / len(copies) == pytest.approx(rate, abs=0.1)


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, "", None), (None, " ", "a")], SCHEMA)).collect()
    assert {(r["size"], r["source_size"], r["target"], r["taken"]) for r in got} == {(0, 0, 0.0, 0)}
    assert len(got) == 3


def test_one_source_is_taken_once(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1), "only") for i in range(50)], SCHEMA)
    assert {r["copies"] for r in mixing.mixed(df).collect()} == {1}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, " \n" + "ab\t" * 2_000_000, "s"), (2, "c", "s")], SCHEMA)
    assert {r["doc_id"]: r["size"] for r in mixing.mixed(df).collect()} == {1: 2_000_000, 2: 1}
