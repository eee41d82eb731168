"""Operators that SQL can't express, against plain Python."""

import math
from collections import Counter, defaultdict

from cellspan.operators import measures, models, raster, spatial
from cellspan.plans import loops
from cellspan.plans.analysis import _rules
from cellspan.sources.views import view

SF = "/root/testdata/sf0.001"


def test_matches_are_those_of_the_greedy_order(spark):
    pairs = [tuple(r) for r in loops._centroid_pairs(spark, SF).collect()]
    a, b, want = set(), set(), set()
    for d, x, y in sorted((round(d, 9), x, y) for x, y, d in pairs):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            want.add((x, y))
    assert {(r.a, r.b) for r in models.greedy_matches(loops._centroid_pairs(spark, SF)).collect()} == want


def test_thinning_keeps_what_the_greedy_order_keeps(spark):
    cells = view(spark, SF, "v_cells")
    points = sorted((r.cell_idx, r.centroid_x, r.centroid_y) for r in cells.collect())
    kept = []
    for i, x, y in points:
        if all((x - u) ** 2 + (y - v) ** 2 > 100 for _, u, v in kept):
            kept.append((i, x, y))
    got = models.thin(cells, 10.0, "cell_idx", "centroid_x", "centroid_y").collect()
    assert sorted(r.cell_idx for r in got) == [i for i, _, _ in kept]


def test_pixels_of_a_ring(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 3.0), (1, 3, 0.0, 3.0), (2, 0, 3.0, 2.0), (2, 1, 6.0, 2.0), (2, 2, 6.0, 5.0), (2, 3, 3.0, 5.0)]
    rings = spark.createDataFrame(rows, "cell_idx int, vertex_ord int, vertex_x double, vertex_y double")
    for last in (True, False):
        got = {(r.px, r.py): r.cell_idx for r in raster.rasterise(rings, 1.0, last).collect()}
        one, two = {(x, y) for x in range(4) for y in range(3)}, {(x, y) for x in range(3, 6) for y in range(2, 5)}
        assert got == {p: (2 if p in two and (last or p not in one) else 1) for p in one | two}


def test_angles_follow_their_neighbours(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 2)]
    start = {1: 0.1, 2: 1.4, 3: 0.2}
    now = dict(start)
    for _ in range(2):
        new = {}
        for n in now:
            score = lambda t, n=n: round(abs(math.cos(t - start[n])) + sum(2.0 * abs(math.cos(t - now[b])) for a, b in edges if a == n), 9)
            new[n] = max((score(i * math.pi / 36), -i) for i in range(36))[1] * -math.pi / 36
        now = new
    got = models.smooth_angles(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(list(start.items()), "node int, angle double"), 2.0, 36, 2)
    assert all(math.isclose(r.angle, now[r.node], abs_tol=1e-9) for r in got.collect())


def test_types_follow_their_neighbours(spark):
    edges = [(1, 2), (1, 3), (2, 1), (3, 1), (3, 4), (4, 3)]
    types, p = {1: "a", 2: "b", 3: "b", 4: "b"}, {("a", "a"): 0.6, ("a", "b"): 0.4, ("b", "a"): 0.2, ("b", "b"): 0.8}
    now = dict(types)
    for _ in range(2):
        near = defaultdict(list)
        for a, b in edges:
            near[a].append(now[b])
        now = {n: min((-round(sum(math.log(p[t, u]) for u in near[n]) + (0.5 if t == now[n] else 0), 9), t) for t in "ab")[1] for n in now}
    got = models.relax_types(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(list(types.items()), "node int, type string"), spark.createDataFrame([(*k, v) for k, v in p.items()], "type_a string, type_b string, p double"), 0.5, 2)
    assert {r.node: r.type for r in got.collect()} == now


def test_consensus_is_calibrated(spark):
    methods = {m: {(r.factor, r.feature_name): r.strength for r in d.collect()} for m, d in _rules(spark, SF).items()}
    keys = Counter(k for d in methods.values() for k in d)
    truth = {k for k, n in keys.items() if n >= 2}
    cut = {}
    for m, d in methods.items():
        best = (-1.0, 0.0)
        for t in sorted(set(d.values())):
            found = {k for k, v in d.items() if v >= t}
            tp = len(found & truth)
            if tp and (f := 2 * tp / (len(found) + len(truth))) > best[0] + 1e-15:
                best = (f, t)
        cut[m] = best[1]
    prior = len(truth) / len(keys)
    hold = lambda v: max(0.02, min(0.98, v))
    rate = {(m, w): hold(sum(k in d for k in keys if (k in truth) == w) / max(sum((k in truth) == w for k in keys), 1)) for m, d in methods.items() for w in (True, False)}
    rows = measures.calibrated_consensus(_rules(spark, SF), ["factor", "feature_name"]).collect()
    assert len(rows) == len(keys)
    for r in rows:
        k = (r.factor, r.feature_name)
        own = [d[k] / cut[m] for m, d in methods.items() if k in d]
        odds = math.log(max(prior, 0.02)) - math.log(max(1 - prior, 0.02))
        odds += sum(math.log(rate[m, True] / rate[m, False]) if k in d else math.log((1 - rate[m, True]) / (1 - rate[m, False])) for m, d in methods.items())
        assert r.n_methods == keys[k] and r.tier == 4 - keys[k]
        assert math.isclose(r.combined_score, math.exp(sum(map(math.log, own)) / len(own)), rel_tol=1e-9)
        assert math.isclose(r.posterior, 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_clusters_of_points(spark):
    points = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 1, 2, 10, 11, 20, 3))], "k int, x double, y double")
    got = {r.k: r.cluster for r in models.dbscan(points, 1.0, 3, "k", "x", "y").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 6: 1}
    assert spatial.radius_join(points, points, 1.0, "k", "x", "y").count() == 8


def test_nearest_vectors_with_ties(spark):
    """Equal cosines go to the smaller id, however many there are around the k-th; a vector of NaN is nobody's neighbour."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(60, [float("nan"), 1.0]), (61, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = models.nearest_vectors(df.selectExpr("id as q", "v"), df.selectExpr("id as b", "v"), 25, side=16).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)
    want = {}
    for i, v in rows:
        near = sorted((-cos(v, u), j) for j, u in rows if j != i and 60 not in (i, j))
        want |= {(i, k): j for k, (_, j) in enumerate(near[:25], 1)}
    assert {(r.q, r["rank"]): r.b for r in got} == want
