"""Whitening against plain eigenvectors, exact integers and odd rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import whitening
from webloom.llm.queries import QUERIES


def by_row(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["vec_id"]][r["component"]] = r
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_against_plain_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r["vec_id"]: [int(np.floor(256 * float(c))) for c in r["embedding"]] for r in table.collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])}
    x = np.array(sorted(set(map(tuple, vectors.values()))))
    n, sums = len(x), [int(s) for s in x.sum(0)]
    centred = x - x.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    got = by_row(QUERIES["op11_whitening"](spark, sf))
    assert set(got) == set(vectors)
    sign = None
    for i, row in vectors.items():
        assert sorted(got[i]) == [1, 2, 3, 4]
        want = (np.array(row) - x.mean(0)) @ v[:, :4] / np.sqrt(e[:4])
        mine = np.array([got[i][k]["whitened"] for k in (1, 2, 3, 4)])
        sign = np.sign(want * mine) if sign is None else sign
        assert np.allclose(mine, sign * want, rtol=1e-9, atol=1e-9)
        for k in (1, 2, 3, 4):
            r = got[i][k]
            assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(row, sums)))
            assert r["explained"] == pytest.approx(e[k - 1] / e.sum(), rel=1e-10) and r["identity_error"] < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [3.0, -1.0]), (8, [0.5, 0.25]), (None, [-0.0, 9.0]), (9, [1.0]), (10, []), (11, [1.0, 2.0, 3.0])]
    odd = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("x", "n", "component", "block", "r", "pos", "label")})
    out = whitening.whiten(odd).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted((i, k) for i in (1, 1, 2, 7, 8, 0) for k in (1, 2))
    assert {r["n"] for r in out} == {4}
    values = {(r["vec_id"], r["component"]): r["whitened"] for r in out}
    assert values[1, 1] == values[2, 1]
    assert whitening.whiten(frame(spark, [])).collect() == [] == whitening.whiten(frame(spark, [(1, None)])).collect()
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance at all
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)
    huge = whitening.whiten(frame(spark, [(i, [1e11 * i, float(i % 3)]) for i in range(5)])).collect()
    assert any(r["deviation"] is None for r in huge) and max(r["identity_error"] for r in huge) < 1e-4


def test_small_deviations_keep_their_accuracy(spark):
    """Columns whose lengths differ by 1e7: a covariance matrix would lose the small one."""
    rng = np.random.default_rng(5)
    a = np.linalg.qr(rng.normal(size=(400, 6)))[0] * np.array([1e9, 1e6, 1e4, 1e3, 1e2, 1e2])
    lengths, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(lengths, [1e9, 1e6, 1e4, 1e3, 1e2, 1e2], rtol=1e-12)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-14)


def test_levels_of_the_tree_give_one_r(spark):
    """Seventy tasks make three levels: R'R stays n V."""
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, size=(700, 5))
    rows = spark.createDataFrame([(row,) for row in x.tolist()], "x array<long>").repartition(70)
    sums = tuple(int(s) for s in x.sum(0))
    assert whitening.exact_sums(rows, 5) == (700, sums)
    r = whitening.tsqr(rows, 5, 700, sums)
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10)
    r = np.zeros((5, 5))
    for i in range(0, 700, 3):  # blocks of fewer rows than columns
        r = whitening.folded(r, whitening.centred(x[i : i + 3], 700, sums))
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10)
