"""Tails of distributions and the rules that rest on them, against plain Python."""

import math
import random
from statistics import mean, variance

import pytest
from pyspark.sql import functions as F

from cellspan.functions import columns
from cellspan.operators import admixture


def tail(t, df, n=200_000):
    """P(T > t) by the midpoint rule over the angle whose tangent is t / sqrt(df)."""
    a = math.atan(t / math.sqrt(df))
    step = (math.pi / 2 - a) / n
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return c * step * sum(math.cos(a + (i + 0.5) * step) ** (df - 1) for i in range(n))


def test_student_tail(spark):
    cases = [(t, df) for df in (1.0, 2.0, 3.7, 30.0, 158.3, 4000.0) for t in (0.0, 0.3, 1.0, 2.5, 6.0, -1.2)] + [(40.0, 25.5)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", columns.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(tail(r.t, r.df, 100_000), rel=1e-6), (r.t, r.df)
    far = spark.createDataFrame([(2.5, 19_999.0), (2.5, 20_001.0)], "t double, df double").select(columns.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    assert far[0].p == pytest.approx(far[1].p, abs=2e-7)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 1e4, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", columns.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)


def test_binomial_tail(spark):
    cases = [(0, 0, 0.5), (3, 10, 0.2), (50, 60, 0.5), (0, 10, 0.0), (4, 4, 1.0), (5, 4, 1.0), (1, 10, 0.9)]
    got = spark.createDataFrame(cases, "k int, n int, p double").select("k", "n", "p", columns.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("tail")).collect()
    for r in got:
        s = math.sqrt(r.n * r.p * (1 - r.p))
        want = 1.0 if r.n == 0 else 0.5 * math.erfc((r.k - r.n * r.p) / s / math.sqrt(2)) if s else 1.0 if r.k <= r.n * r.p else 1e-12
        assert r.tail == pytest.approx(want, abs=1e-7)


def test_neighbor_rules(spark):
    """A factor of type s that spills into cells of type a beside s; type b has none of it."""
    rng = random.Random(3)
    types = {f"c{i}": ["s", "a", "b", None][i % 4] for i in range(400)}
    names = sorted(types, key=lambda c: int(c[1:]))
    edges = [(c, rng.choice(names)) for c in names for _ in range(1)]
    beside = {c: {types[d] for s, d in edges if s == c} for c in names}
    shares = []
    for c in names:
        if types[c] == "s":
            shares.append((c, types[c], 1, 0.8))
        elif types[c] == "a":
            v = max(0.0, rng.gauss(0.2 if "s" in beside[c] else 0.1, 0.03))
            shares += [(c, types[c], 1, v), (c, types[c], 2, 1 - v)]
        elif types[c] and rng.random() < 0.5:
            shares.append((c, types[c], 1, abs(rng.gauss(0, 0.1))))
    fractions = spark.createDataFrame(shares, "cell_id string, cell_type string, factor int, share double")
    native = admixture.native_types(fractions)
    assert {r.factor: r.source for r in native.collect()} == {1: "s", 2: "a"}
    df = admixture.cooccurrence(fractions, spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(types.items()), "cell_id string, cell_type string"), native)
    got = {(r.factor, r.target): r for r in admixture.neighbor_rules(df, least=10).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "s"), (2, "b")}
    of = {(c, f): v for c, _, f, v in shares}
    for (f, t), r in got.items():
        source = {1: "s", 2: "a"}[f]
        on, off = ([of.get((c, f), 0.0) for c in names if types[c] == t and (source in beside[c]) == k] for k in (True, False))
        assert (r.n_with, r.n_without) == (len(on), len(off)) and r.delta == pytest.approx(mean(on) - mean(off))
        q1, q0 = variance(on) / len(on), variance(off) / len(off)
        if q1 + q0:
            want = (mean(on) - mean(off)) / math.sqrt(q1 + q0)
            free = (q1 + q0) ** 2 / (q1**2 / (len(on) - 1) + q0**2 / (len(off) - 1))
            assert r.t == pytest.approx(want) and r.df == pytest.approx(free) and r.p == pytest.approx(2 * tail(abs(want), free, 20_000), rel=1e-5)
    assert [k for k, r in got.items() if r.is_rule] == [(1, "a")]
    assert not any(r.is_rule for r in admixture.neighbor_rules(df, least=60).collect())
