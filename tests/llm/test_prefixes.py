import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, run=5, most=9):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, run))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c, n in members if n == len(p))
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(c for c, _ in members), len(p), up, len(members), children, len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(rng, n):
    texts = ["", "hi", "é" * 5, "how", "why not", None, "x" * 40]
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        length = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(c, rng.choice([None, j, j, j]), rng.choice(["user", "user", "bot", None]), rng.choice(texts)) for j in range(length)]
    hot = next(r[0] for r in rows)
    rows += [(hot + 5 * (n + k), j, "user", x) for k in range(15) for j, x in enumerate(["same start", "same next", "same end"])]
    rows += [(7 * n, j, "bot", f"turn {j % 3}") for j in range(150)]  # one conversation over several partitions
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def listed(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 64), (3, 2), (4, 5)])
def test_against_brute_force(spark, seed, bits):
    """With few bits fingerprints collide everywhere, and verification alone tells nodes apart."""
    rows = rows_of(random.Random(seed), 30)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'f' AS fp", "2 AS part", "3 AS idx", "'m' AS rep").repartition(3)
    assert listed(prefixes.trie(df, bits=bits)) == brute(rows)


def test_as_they_are(spark):
    rows = rows_of(random.Random(9), 12)
    assert listed(prefixes.trie(spark.createDataFrame(rows, SCHEMA), run=1)) == brute(rows, run=1)


def test_empty_and_turnless(spark):
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixes.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    short = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(short, 0, None, None)]
    got = prefixes.trie(spark.createDataFrame(rows, SCHEMA))
    assert listed(got) == brute(rows)
    assert got.count() == 1


def test_very_long_turns(spark):
    rows = [(c, j, "user", ("wort " * 200_000) + str(c % 2 if j else 0)) for c in (10, 11, 12, 20) for j in range(2)]
    assert listed(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_scan_in_pieces():
    """A scan over batches equals one over all rows, and one turn after the other."""
    rng = np.random.default_rng(0)
    conv = np.sort(rng.integers(0, 6, 60))
    hashes, sizes = rng.integers(-(2**63), 2**63 - 1, 60), rng.integers(0, 9, 60)
    whole = prefixes.scan(conv, hashes, sizes, None)
    held, parts = None, []
    for a in range(0, 60, 7):
        p = prefixes.scan(conv[a : a + 7], hashes[a : a + 7], sizes[a : a + 7], held)
        held = int(conv[min(a + 7, 60) - 1]), int(p[0][-1]), int(p[1][-1]), int(p[2][-1])
        parts.append(p)
    for i in range(3):
        assert np.array_equal(np.concatenate([p[i] for p in parts]), whole[i])
    fp = 0
    for k in range(60):
        fp = ((0 if k == 0 or conv[k] != conv[k - 1] else fp) * prefixes.MULTIPLIER + int(hashes[k])) % (1 << 64)
        assert fp == int(whole[1][k])


def test_long_conversation_is_split(spark):
    """Turns of one conversation lie in several partitions and still have one numbering."""
    df = spark.createDataFrame([(3, j, "user", f"t{j}") for j in range(400)], SCHEMA).repartition(4)
    turns = prefixes.scanned(df)
    assert "k0" in turns._jdf.queryExecution().analyzed().toString()
    got = turns.orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1, 401))
    fp = 0
    for r in got:
        fp = (fp * prefixes.MULTIPLIER + r["turn_hash"]) % (1 << 64)
        assert r["fp"] % (1 << 64) == fp
    assert got[-1]["upto"] == sum(len(f"t{j}") for j in range(400))
    assert turns.agg(F.max("idx")).first()[0] == 400
