import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=16):
    """{(id, component): (n, deviation, whitened, explained)} by numpy's eigenvectors of the whole covariance."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fine]
    once = np.array(sorted(set(map(tuple, x))))
    n, sums = len(once), once.sum(axis=0)
    a = (n * once - sums) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), row in zip(fine, x, strict=True):
        d = n * np.array(row) - sums
        z = (d / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        for k in range(min(components, len(e))):
            if e[k] > 1e-12 * e.sum():
                out[i, k + 1] = (n, int((d.astype(object) ** 2).sum()), z[k], e[k] / e.sum())
    return out


def agree(got, want):
    """Rows agree, with one sign for all rows of a component."""
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, z, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-8
        if abs(z) > 1e-6:
            sign = signs.setdefault(r["component"], math.copysign(1, z * r["whitened"]))
            assert r["whitened"] * sign == pytest.approx(z, rel=1e-6, abs=1e-8)


def vectors(n, dim, decay, seed=3):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return (rng.standard_normal((n, dim)) * (50 * decay ** np.arange(dim)) @ turn).astype(np.float32).tolist()


@pytest.mark.parametrize("decay", [0.98, 0.75])
def test_components(spark, decay):
    """A flat spectrum needs the full dimension; a steep one is resolved by power passes."""
    rows = list(enumerate(vectors(400, 40, decay)))
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    agree(got, brute(rows))


def test_power_passes_are_enough_for_a_gap(spark, monkeypatch):
    seen = []
    kept = whitening._added
    monkeypatch.setattr(whitening, "_added", lambda rows, shape, of, dim: seen.append(shape) or kept(rows, shape, of, dim))
    rng = np.random.default_rng(5)
    strong = rng.standard_normal((300, 3)) * [4000, 2000, 900] @ rng.standard_normal((3, 30))
    df = spark.createDataFrame([(i, v) for i, v in enumerate((strong + rng.standard_normal((300, 30))).astype(np.float32).tolist())], SCHEMA)
    _, w = whitening.fit(df, components=3, oversampling=4, power_passes=6)
    assert (30, 7) in seen
    assert (30, 30) not in seen
    assert w.identity_error < 1e-9


def test_rows_that_do_not_count(spark):
    rows = list(enumerate(vectors(50, 6, 0.7)))
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (105, [1.0, 2.0]), (106, [3e38] * 6)]
    extra = [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1])]
    df = spark.createDataFrame(rows + bad + extra, SCHEMA).selectExpr("*", "1 AS x", "'n' AS n", "2 AS id", "3 AS part").repartition(4)
    got = whitening.whitened(df).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows} | {None}
    agree([r for r in got if r["vec_id"] not in (None, 3)], {k: v for k, v in brute(rows).items() if k[0] != 3})
    assert sum(r["vec_id"] == 3 for r in got) == 18


def test_few_vectors(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0, 5.0]), (2, [1.0, 4.0, 5.0])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    agree(got, brute(rows))
    assert len(got) == 2


def test_values_beyond_64_bits(spark):
    rows = [(i, [c, -c / 2]) for i, c in enumerate([1e9, -2e9, 3.5e9, 0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    for r in got:
        n, deviation, z, _ = want[r["vec_id"], r["component"]]
        assert r["n"] == n
        assert r["deviation"] == (deviation if deviation < 1 << 63 else None)
        assert abs(r["whitened"]) == pytest.approx(abs(z), rel=1e-6)
    assert any(r["deviation"] is None for r in got)


def test_dimension_ties_go_to_the_longer(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 3.0]), (4, [2.0, 9.0])], SCHEMA)
    assert {r["vec_id"] for r in whitening.whitened(df).select(F.col("vec_id")).collect()} == {3, 4}
