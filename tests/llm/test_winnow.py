import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(rows):
    ids = [r for r in rows if r[0] is not None]
    return sorted(ids, key=lambda r: (-r[0], r[1] or "")) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1] or "")


def test_edits_and_likeness(spark, docs, rows):
    got = winnow.edits(docs).withColumn("sha", F.sha2("edited", 256)).collect()
    in_order, want = order(rows), []
    for r, after in zip(in_order, [*in_order[1:], in_order[0]], strict=True):
        a, b = r[1] or "", after[1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((r[0], len(a), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, ((r["doc_id"], r["n_chars"], r["sha"]) for r in got))) == sorted(map(repr, want))
    told = {}
    for r, after in zip(in_order, [*in_order[1:], in_order[0]], strict=True):
        a, b = r[1] or "", after[1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        own = {h for h, _ in slow(a)}
        likeness = [len(own & x) / len(own | x) if own | x else 1.0 for x in ({h for h, _ in slow(edited)}, {h for h, _ in slow(b)})]
        told.setdefault((r[0], len(a), edited), []).append(likeness)
    for r in got:
        assert [r["near_edited"], r["near_next"]] in told[r["doc_id"], r["n_chars"], r["edited"]]


def test_ranges_follow_each_other(spark):
    df = spark.range(0, 5000, 3).selectExpr("id AS doc_id", "cast(id AS string) AS text").unionByName(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    got = dict(winnow.with_next(df, "doc_id", ["text"], rows=50).select("text", "next_text").collect())
    ids = [*(str(i) for i in range(4998, -1, -3)), "n"]
    assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))


def slow(text, k=winnow.K, window=winnow.WINDOW):
    """(hash, place) of the fingerprints, with hashes of its own."""
    units = [u for w in WORD.findall(text) for u in (list(w) if len(w) > winnow.LONG_WORD else [w])]
    each = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    runs = []
    for i in range(max(1, len(each) - k + 1) if each else 0):
        h = 42
        for x in each[i : i + k]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        runs.append(h >> (64 - winnow.HASH))
    parts = [range(j, min(j + window, len(runs))) for j in range(max(1, len(runs) - window + 1) if runs else 0)]
    return [(runs[i], i) for i in sorted({max(i for i in part if runs[i] == min(runs[j] for j in part)) for part in parts})]


def test_winnowing_equals_brute_force(spark, docs, rows):
    """Each window's least hash, of equal ones the rightmost, and its place; hashes are made anew."""
    long = [(1000, "字" * 30 + "".join(chr(0x4E00 + 7 * i % 900) for i in range(200)), 1), (1001, "x" * 21 + " short", 1)]
    more = spark.createDataFrame(long, "doc_id long, text string, h_fp int")
    df = winnow.with_fingerprints(docs.selectExpr("doc_id", "text", "1 AS h_fp").unionByName(more), {"fp": "text"})
    for r in df.collect():
        got = [(x >> winnow.PLACE, (1 << winnow.PLACE) - 1 - (x & ((1 << winnow.PLACE) - 1))) for x in r["fp"]]
        assert got == slow(r["text"] or "")


def test_texts_without_blanks_are_alike_by_their_halves(spark):
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(600))
    df = spark.createDataFrame([(2, text), (1, "other words " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r["near_edited"] for r in winnow.edits(df).collect()}
    assert 0.2 < got[2] < 0.9


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 97])
def test_ranges_are_looked_up_in_two_steps(spark, n):
    cuts = [3 * i for i in range(n)]
    got = spark.range(-2, 3 * n + 2).select("id", winnow._above(cuts, F.col("id")).alias("above")).collect()
    assert all(r["above"] == sum(c >= r["id"] for c in cuts) for r in got)


def test_shared_runs_are_met(spark):
    """Any window + k - 1 words that two texts share give a fingerprint in both."""
    shared = [f"s{i}" for i in range(winnow.WINDOW + winnow.K - 1)]
    texts = [(i, " ".join([f"a{i}{j}" for j in range(i)] + shared + [f"b{i}{j}" for j in range(2 * i)])) for i in range(25)]
    df = winnow.with_fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), {"fp": "text"}).select(winnow.hashes("fp").alias("h"))
    sets = [set(r["h"]) for r in df.collect()]
    assert all(a & b for a in sets for b in sets)


def test_equal_texts_and_empty(spark, docs, empty):
    got = winnow.with_fingerprints(docs.select("text"), {"fp": "text"}).select("text", winnow.written("fp").alias("w")).distinct().groupBy("text").count()
    assert got.where("count > 1").count() == 0
    assert winnow.edits(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n", max_size=20), min_size=1, max_size=5))
def test_likeness_of_a_text_with_itself(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = winnow.with_fingerprints(df, {"fp": "text"}).select(winnow.hashes("fp").alias("a")).select(winnow.likeness("a", "a").alias("x"))
    assert {r["x"] for r in got.collect()} == {1.0}
