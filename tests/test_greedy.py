"""Thinning and matching against plain Python, with chains, ties and repeated rows."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellspan.operators import assignment, suppression


def thinned(rows, distance, closed):
    kept = []
    for key, x, y, *_ in rows:
        if all((d := (x - a) ** 2 + (y - b) ** 2) > distance**2 or (not closed and d == distance**2) for _, a, b in kept):
            kept.append((key, x, y))
    return {k for k, _, _ in kept}


def test_a_long_chain(spark):
    rows = [(i, float(i), 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "cell_idx bigint, centroid_x double, centroid_y double")
    assert {r.cell_idx for r in suppression.suppress(df, 1.5, []).collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("closed", [False, True])
def test_thinning_in_order(spark, closed):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(40)), float(rng.randrange(40)), rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "cell_idx bigint, centroid_x double, centroid_y double, score int").repartition(5)
    want = thinned(sorted(rows, key=lambda r: (-r[3], r[1], r[0])), 5.0, closed)
    order = [-F.col("score"), F.col("centroid_x")]
    assert {r.cell_idx for r in suppression.suppress(df, 5.0, order, closed=closed).collect()} == want
    assert suppression.suppress(df.limit(0), 5.0, order).count() == 0


def greedy(pairs):
    a, b, out = set(), set(), set()
    for d, i, j in sorted((d, i, j) for i, j, d in pairs):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            out.add((i, j))
    return out


def test_nearest_pairs(spark):
    chain = [(i // 2, (i + 1) // 2, 500.0 - i) for i in range(140)]
    rng = random.Random(2)
    other = [(1000 + rng.randrange(40), 1000 + rng.randrange(40), float(rng.randrange(9))) for _ in range(400)]
    least = {}
    for a, b, d in chain + other:
        least[a, b] = min(d, least.get((a, b), d))
    df = spark.createDataFrame(chain + other, "a bigint, b bigint, d double")
    got = {(r.a, r.b) for r in suppression.nearest_pairs(df).collect()}
    assert got == greedy([(a, b, d) for (a, b), d in least.items()])
    assert suppression.nearest_pairs(df.limit(0)).count() == 0


def optimum(pairs):
    """(pairs, cost) of the best matching, by trying all."""
    cost = {}
    for a, b, c in pairs:
        cost[a, b] = min(c, cost.get((a, b), c))
    best = (0, 0.0)
    for k in range(1, len(cost) + 1):
        fits = [sum(cost[p] for p in some) for some in itertools.combinations(cost, k) if len({p[0] for p in some}) == len({p[1] for p in some}) == k]
        if not fits:
            break
        best = (k, min(fits))
    return best


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.sampled_from([0.0, 1.0, 1.5, 2.0, 7.0, 50.0])), max_size=9))
@settings(max_examples=150, deadline=None)
def test_best_matching(pairs):
    got = assignment.best_matching(pairs)
    assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
    assert (len(got), sum(c for _, _, c in got)) == pytest.approx(optimum(pairs))


def test_matches_of_components(spark):
    rng = random.Random(4)
    pairs = [(10 * g + rng.randrange(4), 10 * g + rng.randrange(4), float(rng.randrange(1, 30))) for g in range(60) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame([*pairs, (None, 1, 1.0), (1, 1, None)], "a bigint, b bigint, cost double").repartition(4)
    got = assignment.match(df).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    best = [optimum([p for p in pairs if p[0] // 10 == g]) for g in range(60)]
    assert (len(got), sum(r.cost for r in got)) == pytest.approx((sum(n for n, _ in best), sum(c for _, c in best)))
    assert assignment.match(df.limit(0)).count() == 0


def test_auction(spark):
    """A component over the bound: costs plus those left over are least to within the steps."""
    rng = random.Random(5)
    pairs = [(a, b, float(rng.randrange(1, 10))) for a in range(5) for b in range(5) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, cost double")
    got = assignment.match(df, most=3, alone=40.0, step=2.0).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    n, cost = optimum(pairs)
    assert n == len(got) and cost <= sum(r.cost for r in got) <= cost + 2.0 * 2 * 10
