"""Exact quantiles by group against sorting, phrases against plain search, and native helpers against the parser's."""

import math
import random

import pytest

from webloom.functions.readability import is_noise_wrapper
from webloom.operators import evaluate, extract, quantiles


def plain(values, q):
    v = sorted(values)
    x = (len(v) - 1) * q
    a = math.floor(x)
    return v[a] + (x - a) * (v[min(a + 1, len(v) - 1)] - v[a])


def test_groups_match_sorting(spark, monkeypatch):
    rng = random.Random(9)
    groups = {"even": [rng.random() for _ in range(6000)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "far": [*(rng.gauss(0, 1) for _ in range(2000)), 1e12, -1e12], "one": [5.0], None: [2.0, 1.0], "same": [7.0] * 500}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("one", float("nan")), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}
    for share in (quantiles.SHARE, 0.0):  # with no range at all the first pass misses ranks, and later ones find them
        monkeypatch.setattr(quantiles, "SHARE", share or 1e-4)
        got = {r["g"]: r for r in quantiles.percentiles(df, "v", ["g"], qs).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g]["n"] == len(values)
            for k, q in qs.items():
                assert got[g][k] == pytest.approx(plain(values, q), rel=1e-12, abs=1e-12)


def test_an_outlier_moves_no_range(spark):
    """What is ordered stays a small share of the rows, however far one value lies."""
    df = spark.range(200_000).selectExpr("if(id = 0, 1e12, rand(3)) AS ms")
    r = evaluate.latency(df).first()
    assert r["n"] == 200_000 and r["p50_ms"] == 0.5 and r["p99_ms"] == 1.0
    assert evaluate.latency(df.filter("ms IS NULL")).first()["p50_ms"] == 0.0


def test_phrases_are_those_of_plain_search(spark):
    rng = random.Random(10)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 30))).replace("beta gamma", "beta  gamma" if rng.random() < 0.3 else "beta gamma") for _ in range(200)] + [None, "", "alpha\nbeta gamma delta"]
    docs += docs[:20]
    items = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 3, 3, 4, 4, 5, 5, 6) for _ in range(4)] + ["pha beta gam", "alpha zeta beta", "beta  gamma", "a", "", None, "\nbeta gamma delta"]
    got = evaluate.phrase_hits(spark.createDataFrame([(t,) for t in docs], "text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()
    want = {i: sum(p in (t or "") for t in docs if t is not None) if p else 0 for i, p in enumerate(items)}
    assert {r["item_id"]: r["n_docs"] for r in got} == want


def test_native_helpers_match_the_parsers(spark):
    names = ["ad-box main", "adsense", "x ads-1", "share", "shared", "toc\tmain", "content", "", None, "related posts", "cookie-banner", " social"]
    rows = [(i, n, r) for i, n in enumerate(names) for r in ("", None, "Navigation", "main")]
    got = extract.noise_flags(spark.createDataFrame(rows, "i int, n string, r string"), "i", "n", "r").collect()
    want = sorted((i, is_noise_wrapper(n or "", r or "")) for i, n, r in rows)
    assert sorted(map(tuple, got)) == want
    texts = [("a", "a", "a"), (" bb ", "é", "x"), (None, "", " "), ("x ", "xy", "\x1cxyz "), ("日", "abc", "")]
    got = extract.best_renderings(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string, c string"), "i", ["a", "b", "c"]).collect()
    size = lambda x: len((x or "").strip().encode())
    assert {r["i"]: r["pick"] for r in got} == {i: max(range(3), key=lambda k: (size(t[k]), -k)) for i, t in enumerate(texts)}


def test_spread_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    extract.spread(spark.range(100).groupBy("id").count())
    assert not tracker.getJobIdsForGroup("spread")
