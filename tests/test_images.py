"""Pixels against plain Python: growth, components, enclosed regions, contours."""

import math
import random
from collections import defaultdict

import pytest

from cellspan.operators import images, raster
from cellspan.plans import images as plans

SF = "/root/testdata/sf0.001"

PIXELS = "scene_id int, y int, x int, label int"


def blobs(seed, size=40, n=14):
    rng = random.Random(seed)
    out = {}
    for label in range(1, n + 1):
        cy, cx, r = rng.randrange(size), rng.randrange(size), rng.uniform(1, 7)
        for y in range(size):
            for x in range(size):
                if (y - cy) ** 2 + (x - cx) ** 2 <= r * r and rng.random() < 0.93:
                    out[y, x] = label
    return out


def frame(spark, images_):
    return spark.createDataFrame([(s, y, x, v) for s, own in images_.items() for (y, x), v in own.items()], PIXELS).repartition(3)


@pytest.mark.parametrize("tile", [8, 64])
def test_growth(spark, tile):
    scenes = {s: blobs(s) for s in (1, 2)}
    extent = spark.createDataFrame([(1, 40, 40), (2, 35, 38)], "scene_id bigint, height int, width int")
    want = set()
    for s, own in scenes.items():
        now = dict(own)
        for _ in range(3):
            grown = dict(now)
            for y in range(-4, 44):
                for x in range(-4, 44):
                    near = max(now.get((y + i, x + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1))
                    if not now.get((y, x)) and near:
                        grown[y, x] = near
            now = grown
        h, w = {1: (40, 40), 2: (35, 38)}[s]
        want |= {(s, y, x, v) for (y, x), v in now.items() if 0 <= y < h and 0 <= x < w}
    assert {tuple(r) for r in images.grow_labels(frame(spark, scenes), 3, extent, tile).collect()} == want


def test_painting(spark):
    masks = [(0, 1, y, x) for y in range(4) for x in range(4)] + [(0, 2, 1, x) for x in range(1, 3)] + [(0, 3, 1, x) for x in range(2, 4)]
    got = {(r.y, r.x): r.label for r in images.paint(spark.createDataFrame(masks, "scene_id int, label int, y int, x int")).collect()}
    assert len(got) == 16 and got[1, 1] == 2 and got[1, 2] == 3 and got[1, 3] == 3 and got[0, 0] == 1


def flood(pixels):
    out, left = {}, set(pixels)
    for p in sorted(pixels):
        if p in left:
            name, todo = p[0] * (1 << 31) + p[1], [p]
            left.discard(p)
            while todo:
                y, x = todo.pop()
                out[y, x] = name
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
    return out


@pytest.mark.parametrize("tile", [4, 16])
def test_components(spark, tile):
    rng = random.Random(tile)
    scenes = {s: {(y, x): 1 for y in range(30) for x in range(30) if rng.random() < 0.6} for s in (0, 3)}
    spiral = {(y, x): 1 for y in range(0, 30, 2) for x in range(30)} | {(y, 29 if y % 4 == 1 else 0): 1 for y in range(1, 29, 2)}
    scenes[5] = spiral
    want = {(s, y, x, c) for s, own in scenes.items() for (y, x), c in flood(own).items()}
    assert {tuple(r) for r in images.pixel_components(frame(spark, scenes), tile).collect()} == want
    assert images.pixel_components(frame(spark, scenes).limit(0), tile).count() == 0


def test_enclosed_regions(spark):
    """A closed ring with a gap of one pixel, an open arc, a ring at the frame, a ring too small."""
    score, size = {}, 60

    def ring(cy, cx, r, share=1.0):
        for k in range(int(8 * r)):
            if k < share * 8 * r:
                score[round(cy + r * math.sin(k / (4 * r) * math.pi)), round(cx + r * math.cos(k / (4 * r) * math.pi))] = 0.5

    ring(15, 15, 8)
    ring(40, 15, 8, 0.6)
    ring(45, 45, 9)
    ring(3, 50, 6)
    ring(20, 40, 2)
    score.pop((15, 23))
    score[45, 45] = 0.05
    rows = [(0, y, x, v) for (y, x), v in score.items() if 0 <= y < size and 0 <= x < size]
    df = spark.createDataFrame(rows, "scene_id int, y int, x int, score double")
    extent = spark.createDataFrame([(0, size, size)], "scene_id int, height int, width int")
    got = sorted(images.enclosed_regions(df, extent, 0.1, 30, 4000, 0.0, 16).collect(), key=lambda r: r.cy)
    ridge = {(y, x) for _, y, x, v in rows if v >= 0.1}
    closed = {(y + i, x + j) for y, x in ridge for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    parts = defaultdict(set)
    for p, c in flood({(y, x): 1 for y in range(size) for x in range(size) if (y, x) not in closed}).items():
        parts[c].add(p)
    want = []
    for c, own in parts.items():
        if any(y in (0, size - 1) or x in (0, size - 1) for y, x in own) or not 30 <= len(own) <= 4000:
            continue
        rim = {(y + i, x + j) for y, x in own for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))} - own
        want.append((c, len(own), len(rim & ridge) / len(rim), sum(score.get(p, 0.0) for p in own) / len(own)))
    assert len(got) == len(want) == 2
    assert {r.component: (r.area, round(r.enclosure, 9), round(r.score, 9)) for r in got} == {c: (a, round(e, 9), round(v, 9)) for c, a, e, v in want}


def test_contours(spark):
    """Rings close, follow the label with it on the right, and their areas add up to the pixels."""
    scenes = {s: blobs(s, 30, 9) for s in (1, 2)}
    scenes[7] = {(y, x): 1 for y in range(6) for x in range(6) if (y, x) not in ((2, 2), (3, 3), (3, 2))} | {(2, 2): 2, (9, 9): 3, (10, 10): 3}
    rows = images.label_contours(frame(spark, scenes)).collect()
    rings, count = defaultdict(dict), defaultdict(int)
    for s, own in scenes.items():
        for v in own.values():
            count[s, v] += 1
    for r in rows:
        rings[r.scene_id, r.label, r.ring][r.ord] = (r.vertex_y, r.vertex_x)
    sizes, areas = {}, defaultdict(float)
    for r in rows:
        sizes[r.scene_id, r.label, r.ring] = (r.length, r.area)
    for key, own in rings.items():
        n, area = sizes[key]
        assert sorted(own) == list(range(n))
        areas[key[:2]] += area
        image = scenes[key[0]]
        for k in range(n):
            (y, x), (y2, x2) = own[k], own[(k + 1) % n]
            assert max(abs(y - y2), abs(x - x2)) <= 1 and (y, x) != (y2, x2)
            ends = [(math.floor(y), math.floor(x)), (math.ceil(y), math.ceil(x))]
            assert sorted(image.get(e) == key[1] for e in ends) == [False, True]
    assert {k: round(v) for k, v in areas.items()} == dict(count)
    sides = sum(image.get((y + i, x + j)) != v for image in scenes.values() for (y, x), v in image.items() for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    assert len(rows) == sides
    assert len({k for k in rings if k[:2] == (7, 3)}) == 2  # diagonal pixels are rings of their own
    assert any(a < 0 for _, a in sizes.values())
    longest = images.label_polygons(frame(spark, scenes)).groupBy("scene_id", "label").count().collect()
    assert {(r.scene_id, r.label): r["count"] for r in longest} == {k: max(sizes[q][0] for q in sizes if q[:2] == k) for k in count}


def test_enclosed_query(spark):
    """The query on the cells' image: every region is one that flooding finds."""
    labels = plans._labels(spark, SF).collect()
    image = {(r.y, r.x): r.label for r in labels}
    edge = {p for p, v in image.items() if any(image.get((p[0] + i, p[1] + j)) != v for i in (-1, 0, 1) for j in (-1, 0, 1))}
    h, w = max(y for y, _ in image) + 3, max(x for _, x in image) + 3
    closed = {(y + i, x + j) for y, x in edge for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    parts = defaultdict(set)
    for p, c in flood({(y, x): 1 for y in range(h) for x in range(w) if (y, x) not in closed}).items():
        parts[c].add(p)
    want = {c: len(own) for c, own in parts.items() if 12 <= len(own) <= 4000 and not any(y in (0, h - 1) or x in (0, w - 1) for y, x in own)}
    assert {r.component: r.area for r in plans.ALL["enclosed_ridges"][0](spark, SF).collect()} == want and want


def test_contours_across_tiles(spark):
    """Tiles of any size give the same rings; a ring within one tile is closed there, so that no join links it."""
    scenes = {s: blobs(s, 30, 9) for s in (1, 2)}
    scenes[3] = {(y, x): 1 for y in range(-20, 20) for x in range(-9, 9) if not (-12 <= y < 12 and -3 <= x < 3)}
    want = {tuple(r) for r in images.label_contours(frame(spark, scenes), 0.5).collect()}
    assert {tuple(r) for r in images.label_contours(frame(spark, scenes), 0.5, 4).collect()} == want
    sides = images.cracks(frame(spark, scenes).where("scene_id < 3"))
    assert sides.where("not closed").isEmpty() and sides.where("pos = 0").count() == len({(s, ring) for s, _, ring, *_ in want if s < 3})
    assert images.label_contours(frame(spark, scenes).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_painting_with_flags(spark, tile):
    """The pixel on top brings its own flag; equal masks: the larger label; masks may lie at negative places and over the words' borders."""
    rng, masks = random.Random(tile), []
    for label in range(1, 30):
        y0, x0, h, w = rng.randrange(-20, 20), rng.randrange(-40, 40), rng.randrange(1, 6), rng.randrange(1, 40)
        masks += [(0, label, y, x, int(rng.random() < 0.5)) for y in range(y0, y0 + h) for x in range(x0, x0 + w)]
    area = defaultdict(int)
    for m in masks:
        area[m[1]] += 1
    want = {}
    for _, label, y, x, flag in sorted(masks, key=lambda m: (-area[m[1]], m[1])):
        want[y, x] = (label, flag)
    got = images.paint(spark.createDataFrame(masks, "scene_id int, label int, y int, x int, f int").repartition(3), "f", tile=tile).collect()
    assert {(r.y, r.x): (r.label, r.f) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("tile", [5, 16])
def test_enclosed_regions_across_tiles(spark, tile):
    """Areas, centres, means and enclosures of regions over many tiles equal those of flooding; what is staged does not hold the pixels."""
    rng, h, w = random.Random(5), 70, 61
    score = {(y, x): rng.choice([0.05, 0.5, 0.9]) for y in range(h) for x in range(w) if rng.random() < 0.09 or y % 23 == 7 or x % 29 == 11}
    ridge = {p for p, v in score.items() if v >= 0.1}
    closed = {(y + i, x + j) for y, x in ridge for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    parts = defaultdict(set)
    for p, c in flood({(y, x): 1 for y in range(h) for x in range(w) if (y, x) not in closed}).items():
        parts[c].add(p)
    want = {}
    for c, own in parts.items():
        if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in own):
            rim = {(y + i, x + j) for y, x in own for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))} - own
            want[c] = (len(own), *(pytest.approx(v) for v in (sum(y for y, _ in own) / len(own), sum(x for _, x in own) / len(own), len(rim & ridge) / len(rim), sum(score.get(p, 0) for p in own) / len(own))))
    df = spark.createDataFrame([(3, y, x, v) for (y, x), v in score.items()], "scene_id int, y int, x int, score double").repartition(3)
    extent = spark.createDataFrame([(3, h, w), (4, 9, 9)], "scene_id int, height int, width int")
    got = {r.component: (r.area, r.cy, r.cx, r.enclosure, r.score) for r in images.enclosed_regions(df, extent, 0.1, 1, 10**6, 0.0, tile).collect()}
    assert got == want and len(want) > 20 and max(v[0] for v in want.values()) > 16


def test_outlines(spark):
    """Outlines by tile are those by joins."""
    labels = frame(spark, {s: blobs(s, 30, 9) for s in (1, 2)})
    want = {tuple(r) for r in raster.boundary(labels).select("scene_id", "y", "x", "label").collect()}
    assert {tuple(r) for r in images.outlines(labels, 7).collect()} == want and want
