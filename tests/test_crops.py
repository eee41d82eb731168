"""Choice of crops and optimal matches against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from cellspan.operators import crops
from cellspan.plans import selection

SF = "/root/testdata/sf0.001"
CELL = "cell_id string, x double, y double, molecules bigint, cell_type string"


def table(rows, spark):
    return spark.createDataFrame(rows, CELL).repartition(3)


def some_cells(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        dense = i % 4 == 0
        x, y = (rng.gauss(60, 15), rng.gauss(60, 15)) if dense else (rng.uniform(0, 300), rng.uniform(0, 300))
        t = None if i % 11 == 0 else "a" if x < 90 else "b" if y < 150 else rng.choice("abc")
        out.append((f"c{i:03d}", round(x, 3), round(y, 3), rng.randrange(50), t))
    return out


def chosen(df, size):
    return [(round(r.xmin + size / 2, 3), round(r.ymin + size / 2, 3)) for r in sorted(df.collect(), key=lambda r: r.crop_id)]


def densities(cells, size):
    square = lambda c: (math.floor(c[1] / (size / 2)), math.floor(c[2] / (size / 2)))
    n = Counter(map(square, cells))
    return {c[0]: sum(n[square(c)[0] + i, square(c)[1] + j] for i in (-1, 0, 1) for j in (-1, 0, 1)) for c in cells}


def test_dense_and_grid_crops(spark):
    cells, size = some_cells(1), 40.0
    ordered = sorted(cells, key=lambda c: (-densities(cells, size)[c[0]], -c[3], c[1], c[2], c[0]))
    kept = []
    for c in ordered:
        if all((c[1] - k[1]) ** 2 + (c[2] - k[2]) ** 2 >= size**2 for k in kept):
            kept.append(c)
    assert len(kept) < 60
    want = [c[1:3] for c in [*kept, *(c for c in ordered if c not in kept)][:60]]
    assert chosen(crops.choose_crops(table(cells, spark), 60, size, selection="density"), size) == want
    # Ten points on a line of cells: far points take the nearest that is left.
    line = [(f"l{i}", float(i), 0.0, 0, None) for i in range(6)]
    got = chosen(crops.choose_crops(table(line, spark), 10, 1.0, bounds=(-20.0, 40.0, -5.0, 5.0), selection="grid"), 1.0)
    assert sorted(got) == [(float(i), 0.0) for i in range(6)] and got[0] == (0.0, 0.0) and got[1] == (1.0, 0.0)


def brute_stratified(cells, n, size, k, alpha, within):
    half = size / 2
    square = lambda c: (math.floor(c[1] / half), math.floor(c[2] / half))
    names, density = sorted({c[4] for c in cells if c[4]}), densities(cells, size)
    typed, own = Counter((*square(c), c[4]) for c in cells if c[4]), Counter(map(square, cells))
    comp = {}
    for bx, by in own:
        near = [sum(typed[bx + i, by + j, t] for i in range(-2, 3) for j in range(-2, 3)) for t in names]
        comp[bx, by] = [v / sum(near) if sum(near) else 0.0 for v in near]
    gap = lambda p, q: round(sum((a - b) ** 2 for a, b in zip(p, q)), 12)
    centres = [comp[min(own, key=lambda b: (-own[b], b))]]
    while len(centres) < max(2, min(k, n, len(cells) // 4)):
        far = min(own, key=lambda b: (-min(gap(comp[b], c) for c in centres), b))
        if min(gap(comp[far], c) for c in centres) <= 0:
            break
        centres.append(comp[far])
    closest = lambda b: min(range(len(centres)), key=lambda i: (gap(comp[b], centres[i]), i))
    for _ in range(25):
        members = defaultdict(list)
        for b in own:
            members[closest(b)].append(b)
        new = list(centres)
        for i, bs in members.items():
            new[i] = [sum(comp[b][t] * own[b] for b in bs) / sum(own[b] for b in bs) for t in range(len(names))]
        moved = max(abs(a - b) for p, q in zip(centres, new) for a, b in zip(p, q))
        centres = new
        if moved < 1e-9:
            break
    groups = defaultdict(list)
    for c in sorted(cells, key=lambda c: (c[1], c[2], c[0])):
        groups[closest(square(c))].append(c)
    quota = {g: min(q, len(groups[g])) for g, q in crops.quotas({g: len(m) for g, m in groups.items()}, n, alpha).items()}
    out = []
    for g in sorted(groups):
        members, picks = groups[g], []
        while len(picks) < quota[g]:
            left = [c for c in members if c not in picks]
            if not picks:
                picks.append(max(left, key=lambda c: density[c[0]]) if within == "density" else min(left, key=lambda c: round(gap(comp[square(c)], centres[g]), 9)))
            else:
                score = lambda c: round(min(math.dist(c[1:3], p[1:3]) for p in picks) * (density[c[0]] if within == "density" else 1), 9)
                picks.append(max(left, key=score))
        out += picks
    return [c[1:3] for c in out[:n]]


@pytest.mark.parametrize(("n", "alpha", "within"), [(12, 0.5, "centroid"), (9, 0.0, "density")])
def test_stratified_crops(spark, n, alpha, within):
    cells = some_cells(n)
    got = chosen(crops.choose_crops(table(cells, spark), n, 40.0, selection="stratified", k=4, alpha=alpha, within=within), 40.0)
    assert got == brute_stratified(cells, n, 40.0, 4, alpha, within) and len(set(got)) == len(got) >= n - 1


def test_quotas():
    assert crops.quotas({0: 100, 1: 100, 2: 1}, 5, 0.0) == {0: 2, 1: 2, 2: 1}
    assert sum(crops.quotas({i: i + 1 for i in range(7)}, 23, 0.5).values()) == 23


def test_odd_cells(spark):
    cells = some_cells(3, 30)
    odd = [(None, 1.0, 1.0, 1, "a"), ("", 1.0, 1.0, 1, "a"), ("n", None, 1.0, 1, "a")]
    df = table([*cells, *odd], spark)
    everyone = sorted(c[1:3] for c in cells)
    for selection_ in ("spread", "random", "density"):
        assert sorted(chosen(crops.choose_crops(df, 99, 40.0, selection=selection_), 40.0)) == everyone
    a, b = (chosen(crops.choose_crops(d, 7, 40.0, selection="random", seed=5), 40.0) for d in (df, df.repartition(9)))
    assert a == b and len(set(a)) == 7
    one = [(c[0], c[1], c[2], c[3], "a") for c in cells]
    assert chosen(crops.choose_crops(table(one, spark), 5, 40.0, selection="stratified"), 40.0) == chosen(crops.choose_crops(table(one, spark), 5, 40.0, selection="density"), 40.0)
    with pytest.raises(ValueError):
        crops.choose_crops(df, 5, 40.0, selection="best")
    with pytest.raises(ValueError):
        crops.choose_crops(df, 5, 40.0, bounds=(0.0, 1.0, 0.0, 1.0))


def assignment_cost(cost):
    """Least sum of a full assignment of a square matrix, by potentials."""
    n = len(cost)
    u, v, of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j, least, way, seen = i, 0, [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while of[j]:
            seen[j], row, delta, to = True, of[j], math.inf, 0
            for k in range(1, n + 1):
                if not seen[k]:
                    d = cost[row - 1][k - 1] - u[row] - v[k]
                    if d < least[k]:
                        least[k], way[k] = d, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            of[j] = of[way[j]]
            j = way[j]
    return sum(cost[of[j] - 1][j - 1] for j in range(1, n + 1))


def test_hungarian_query(spark):
    pairs = selection._pairs(spark, SF, 11.0).collect()
    a, b = (sorted({r[i] for r in pairs}) for i in (0, 1))
    n, big = max(len(a), len(b)), 1e5
    cost = [[big] * n for _ in range(n)]
    for r in pairs:
        cost[a.index(r.a)][b.index(r.b)] = r.cost
    got = selection.ALL["hungarian_match"][0](spark, SF).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    assert sum(r.cost for r in got) + big * (n - len(got)) == pytest.approx(assignment_cost(cost), abs=1e-3)
    summary = selection.ALL["hungarian_summary"][0](spark, SF).first()
    assert summary.matched == len(got) and summary.rate_a == pytest.approx(len(got) / 75, abs=1e-6)
