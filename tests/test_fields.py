"""Random fields against plain Python with the same counted draws, for any partitioning."""

import math
import random
import struct
from collections import Counter

import pytest
import xxhash

from cellspan.operators import fields


def hashed(*key):
    h = 42
    for v in key:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def draw(*key):
    return (hashed(*key) >> 11) / (1 << 53)


def pick(weights, u):
    total, upto = sum(weights), 0.0
    for i, w in enumerate(weights):
        upto += w
        if upto > u * total:
            return i
    return len(weights) - 1


def graph(seed, n=60):
    rng = random.Random(seed)
    return sorted({(a, b) for a in range(n) for b in rng.sample(range(n), 4) if a != b})


def frames(spark, edges, n=60):
    return spark.createDataFrame([(i,) for i in range(n)], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint")


def test_colours(spark):
    edges = graph(1)
    nodes, e = frames(spark, edges)
    got = {r.node: r.colour for r in fields.colours(e, nodes).collect()}
    assert set(got) == set(range(60)) and all(got[a] != got[b] for a, b in edges)
    assert max(got.values()) <= max(Counter(x for p in edges for x in p).values())
    assert got == {r.node: r.colour for r in fields.colours(e.repartition(5), nodes.repartition(3)).collect()}
    assert fields.colours(e, nodes.limit(0)).count() == 0


PRIOR = {"a": 0.5, "b": 0.3, "c": 0.2}
COND = {("a", "a"): 0.8, ("a", "b"): 0.1, ("b", "b"): 0.7, ("b", "a"): 0.2, ("c", "c"): 0.9, ("c", "a"): 0.05, ("a", "c"): 0.1}


def test_gibbs(spark):
    edges = graph(2)
    nodes, e = frames(spark, edges)
    colour = {r.node: r.colour for r in fields.colours(e, nodes).collect()}
    names, seed = sorted(PRIOR), 5
    now = {i: pick([PRIOR[t] for t in names], draw(i, seed, 0)) for i in range(60)}
    for sweep in (1, 2):
        for c in sorted(set(colour.values())):
            new = {}
            for i in (i for i in now if colour[i] == c):
                n = Counter(now[b] for a, b in edges if a == i)
                s = [math.log(PRIOR[t]) + sum(n[k] * math.log(max(COND.get((t, u), 0), 1e-6)) for k, u in enumerate(names)) for t in names]
                new[i] = pick([math.exp(v - max(s)) for v in s], draw(i, seed, sweep))
            now |= new
    got = {r.node: r.type for r in fields.gibbs_types(nodes, e, PRIOR, COND, 2, seed, rebalance=False).collect()}
    assert got == {i: names[t] for i, t in now.items()}
    again = {r.node: r.type for r in fields.gibbs_types(nodes.repartition(3), e.repartition(7), PRIOR, COND, 2, seed).collect()}
    n = Counter(again.values())
    assert all(abs(n[t] - PRIOR[t] * 60) <= 2.5 for t in names)
    moved = [i for i in again if again[i] != got[i]]
    before = Counter(got.values())
    assert len(moved) == sum(max(0, round(before[t] - PRIOR[t] * 60)) for t in names)


def test_many_draws_follow_the_prior(spark):
    """Without edges types are draws from the prior, unlike for another seed."""
    nodes, e = frames(spark, [(0, 1)], 4000)
    one, two = ({r.node: r.type for r in fields.gibbs_types(nodes, e.limit(0), PRIOR, COND, 1, seed, rebalance=False).collect()} for seed in (1, 2))
    for got in (one, two):
        n = Counter(got.values())
        assert all(abs(n[t] / 4000 - PRIOR[t]) < 0.03 for t in PRIOR)
    same = sum(one[i] == two[i] for i in one) / 4000
    assert abs(same - sum(p * p for p in PRIOR.values())) < 0.04


def test_tilts(spark):
    edges = graph(3, 30)
    rng = random.Random(4)
    start = {i: (rng.random() * math.pi, rng.choice([0.5, 1.0, 3.0])) for i in range(30)}
    now = {i: a for i, (a, _) in start.items()}
    grid = [math.pi * k / 36 for k in range(36)]
    for sweep in (1, 2, 3):
        new = {}
        for i in now:
            anchor, ratio = start[i]
            s = [abs(math.cos(c - anchor)) * max(0.0, ratio - 1) + sum(2.0 * abs(math.cos(c - now[b])) for a, b in edges if a == i) for c in grid]
            new[i] = grid[pick([math.exp(v - max(s)) for v in s], draw(i, 9, sweep))]
        now = new
    df = spark.createDataFrame([(i, a, r) for i, (a, r) in start.items()], "node bigint, angle double, ratio double")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    for parts in (1, 5):
        got = {r.node: r.angle for r in fields.sample_tilts(e.repartition(parts), df.repartition(parts), sweeps=3, seed=9).collect()}
        assert got == pytest.approx(now)
