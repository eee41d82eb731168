"""Label images as rows of pixels: painted masks, growth, connected components, enclosed regions and contours.

Work that needs the pixels around goes tile by tile: a tile gets the pixels of its core and of a halo as wide as the work
reaches, so one shuffle is enough and no tile sees more than a set number of pixels.  What reaches farther (components, rings)
is settled by graphs over tiles or by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators.models import components
from cellspan.operators.staging import cut

#: Side of a tile in pixels.
TILE = 256


#: Neighbouring pixels of a row that one number holds, a bit each.
WORD = 32


def tiled(pixels: DataFrame, halo: int, tile: int) -> DataFrame:
    """pixels with (ty, tx), once for every tile whose core or halo they lie in."""
    out = pixels
    for t, v in (("ty", "y"), ("tx", "x")):
        out = out.withColumn(t, F.explode(F.sequence(F.floor((F.col(v) - halo) / tile), F.floor((F.col(v) + halo) / tile))))
    return out


def packed(pixels: DataFrame, *flags: str) -> DataFrame:
    """(scene_id, label, y, w, bits, n) of pixels (scene_id, y, x, label): bit k of bits is the pixel 32 w + k; n: rows that went in.

    flags: columns of 0 and 1, each a number of bits of its own.  Pixels are packed batch by batch, so a word may come in several rows, each with its own
    bits; nothing is shuffled or held for it.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            label, scene, y, x = (p[c].to_numpy() for c in ("label", "scene_id", "y", "x"))
            w, bit = x >> 5, np.int64(1) << (x & (WORD - 1))
            order = np.lexsort((w, y, label, scene))
            here = np.stack([scene, label, y, w])[:, order]
            start = np.nonzero(np.append(len(p) > 0, (here[:, 1:] != here[:, :-1]).any(axis=0)))[0]
            join = lambda v: np.bitwise_or.reduceat(v[order], start) if len(start) else v  # noqa: E731, B023
            out = dict(zip(("scene_id", "label", "y", "w"), here[:, start], strict=True)) | {"bits": join(bit), "n": np.diff(np.append(start, len(p)))}
            yield pd.DataFrame(out | {f: join(np.where(p[f].to_numpy() != 0, bit, 0)) for f in flags})

    own = pixels.select(*(F.col(c).cast("long").alias(c) for c in ("scene_id", "label", "y", "x")), *flags)
    return own.mapInPandas(pack, ", ".join(f"{c} bigint" for c in ("scene_id", "label", "y", "w", "bits", "n", *flags)))


def words_tiled(words: DataFrame, halo: int, tile: int) -> DataFrame:
    """packed() rows with (ty, tx), once for every tile whose core or halo one of their pixels may lie in."""
    out = words.withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - halo) / tile), F.floor((F.col("y") + halo) / tile))))
    low = F.col("w") * WORD
    return out.withColumn("tx", F.explode(F.sequence(F.floor((low - halo) / tile), F.floor((low + (WORD - 1 + halo)) / tile))))


def blocks(pixels: DataFrame, value: str, halo: int, tile: int) -> DataFrame:
    """(scene_id, ty, tx, at, v): pixels (scene_id, y, x, value) as arrays, once for every tile whose core or halo they lie in.

    at: the pixel's number in the square of the tile and its halo.  Arrays are made batch by batch, so a tile's pixels may come in several rows.
    """
    side = tile + 2 * halo

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            scene, y, x, v = (p[c].to_numpy() for c in ("scene_id", "y", "x", "v"))
            parts = []
            for i in range(2 * halo // tile + 2):
                for j in range(2 * halo // tile + 2):
                    ty, tx = (y - halo) // tile + i, (x - halo) // tile + j
                    on = (ty <= (y + halo) // tile) & (tx <= (x + halo) // tile)
                    at = (y - ty * tile + halo) * side + x - tx * tile + halo
                    parts.append([c[on] for c in (scene, ty, tx, at, v)])
            *key, at, v = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort(key[::-1])
            key, at, v = np.stack(key)[:, order], at[order].astype(np.int32), v[order]
            start = np.nonzero(np.append(len(at) > 0, (key[:, 1:] != key[:, :-1]).any(axis=0)))[0]
            cut_at = lambda c: np.split(c, start[1:]) if len(start) else []  # noqa: E731, B023
            yield pd.DataFrame(dict(zip(("scene_id", "ty", "tx"), key[:, start], strict=True)) | {"at": cut_at(at), "v": cut_at(v)})

    own = pixels.select(*(F.col(c).cast("long").alias(c) for c in ("scene_id", "y", "x")), F.col(value).cast("double").alias("v")).where("v is not null")
    return own.mapInPandas(deal, "scene_id bigint, ty bigint, tx bigint, at array<int>, v array<double>")


def unpacked(p: pd.DataFrame, y0: int, x0: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, row, bit) of the set pixels of packed rows within the square of ``side`` pixels at (y0, x0), in its own coordinates and the rows' order."""
    row, bit = np.nonzero((p["bits"].to_numpy()[:, None] >> np.arange(WORD)) & 1)
    y, x = p["y"].to_numpy()[row] - y0, p["w"].to_numpy()[row] * WORD + bit - x0
    ok = (y >= 0) & (y < side) & (x >= 0) & (x < side)
    return y[ok], x[ok], row[ok], bit[ok]


def paint(masks: DataFrame, *flags: str, tile: int = TILE) -> DataFrame:
    """(scene_id, y, x, label) of masks (scene_id, label, y, x) laid over each other: the smallest mask is on top, of equal ones the larger label.

    flags: columns of masks, 0 or 1, that the pixel on top brings with it.  Masks travel packed; a tile lays its own in order.
    """

    def laid(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        p = p.sort_values(["area", "label"], ascending=[False, True])
        y, x, row, bit = unpacked(p, ty * tile, tx * tile, tile)
        top = np.full((tile, tile), -1, np.int64)
        top[y, x] = np.arange(len(y))  # the last one stays
        top = top[top >= 0]
        own = {f: (p[f].to_numpy()[row[top]] >> bit[top]) & 1 for f in flags}
        return pd.DataFrame({"scene_id": scene, "y": y[top] + ty * tile, "x": x[top] + tx * tile, "label": p["label"].to_numpy()[row[top]]} | own)

    own = cut(packed(masks, *flags), "masks")
    area = own.groupBy("scene_id", "label").agg(F.sum("n").alias("area"))
    own = own.join(area.hint("shuffle_hash"), ["scene_id", "label"]).drop("n")
    names = ("scene_id", "y", "x", "label", *flags)
    out = words_tiled(own, 0, tile).groupBy("scene_id", "ty", "tx").applyInPandas(laid, ", ".join(f"{c} bigint" for c in names))
    return out.select(*(F.col(c).cast(masks.schema[c].dataType).alias(c) for c in names))


def grow_labels(labels: DataFrame, margin: int, extent: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Labels grown ``margin`` times into the background by the 3 x 3 square around; the larger label wins.  Rows of labels above 0 only.

    labels: scene_id, y, x, label; what has no row is background.  extent (scene_id, height, width): growth ends there.
    """

    def grown(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        side = tile + 2 * margin
        image = np.zeros((side + 2, side + 2), np.int64)  # a frame of background
        y0, x0 = ty * tile - margin, tx * tile - margin
        y, x, row, _ = unpacked(p, y0, x0, side)
        image[y + 1, x + 1] = p["label"].to_numpy()[row]
        for _ in range(margin):
            rows = np.maximum(np.maximum(image[:-2], image[1:-1]), image[2:])
            near = np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
            core = image[1:-1, 1:-1]
            image[1:-1, 1:-1] = np.where(core == 0, near, core)
        core = image[1 + margin : 1 + margin + tile, 1 + margin : 1 + margin + tile]
        y, x = np.nonzero(core)
        return pd.DataFrame({"scene_id": scene, "y": y + ty * tile, "x": x + tx * tile, "label": core[y, x]})

    own = packed(labels.where("label > 0")).drop("n")
    out = words_tiled(own, margin, tile).groupBy("scene_id", "ty", "tx").applyInPandas(grown, "scene_id bigint, y bigint, x bigint, label bigint")
    if extent is not None:
        out = out.join(extent, "scene_id").where((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") >= 0) & (F.col("x") < F.col("width"))).drop("height", "width")
    return out


def first_of_piece(mask: np.ndarray) -> np.ndarray:
    """For each set pixel of a square the number (row * side + column) of the first one that it is four-connected with."""
    side = len(mask)
    order = np.full((side + 2, side + 2), side * side, np.int64)
    order[1:-1, 1:-1][mask] = np.nonzero(mask.ravel())[0]
    while True:  # the least number spreads along rows and columns, and to the least number of that
        low = order.copy()
        for axis in (0, 1):
            for step in (1, -1):
                near = np.roll(low, step, axis)
                low = np.where(order < side * side, np.minimum(low, near), order)
        flat = np.append(low[1:-1, 1:-1].ravel(), side * side)
        low[1:-1, 1:-1] = flat[low[1:-1, 1:-1]]
        if (low == order).all():
            return order[1:-1, 1:-1]
        order = low


def pixel_components(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(scene_id, y, x, component) of set pixels (scene_id, y, x): four-connected components, named by their first pixel's number.

    Tiles number their own pieces; pieces that touch across a border are the edges of a graph, whose components name the pieces.
    """

    def pieces(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        y, x = p["y"].to_numpy() - ty * tile, p["x"].to_numpy() - tx * tile
        mask = np.zeros((tile, tile), bool)
        mask[y, x] = True
        first = first_of_piece(mask)[y, x]
        return pd.DataFrame({"scene_id": scene, "y": p["y"], "x": p["x"], "piece": _number(first // tile + ty * tile, first % tile + tx * tile)})

    own = pixels.select(F.col("scene_id").cast("long"), F.col("y").cast("long"), F.col("x").cast("long")).distinct()
    found = tiled(own, 0, tile).groupBy("scene_id", "ty", "tx").applyInPandas(pieces, "scene_id bigint, y bigint, x bigint, piece bigint")
    found = cut(found, "pieces")
    # Links across the borders of tiles.
    links = None
    for a, b in (("y", "x"), ("x", "y")):
        low = found.where(F.pmod(F.col(a), F.lit(tile)) == tile - 1).select("scene_id", (F.col(a) + 1).alias(a), b, F.col("piece").alias("one"))
        met = low.join(found.where(F.pmod(F.col(a), F.lit(tile)) == 0).select("scene_id", a, b, F.col("piece").alias("two")), ["scene_id", a, b]).select("scene_id", "one", "two")
        links = met if links is None else links.unionByName(met)
    names = cut(found.select("scene_id", "piece").distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    links = links.distinct().join(names.select("scene_id", F.col("piece").alias("one"), F.col("id").alias("a")), ["scene_id", "one"]).join(names.select("scene_id", F.col("piece").alias("two"), F.col("id").alias("b")), ["scene_id", "two"])
    groups = components(links.select("a", "b"))
    named = names.join(groups, names["id"] == groups["node"], "left").select("scene_id", "piece", F.coalesce("component", "id").alias("group"))
    least = named.groupBy("scene_id", "group").agg(F.min("piece").alias("component"))
    named = named.join(least, ["scene_id", "group"]).select("scene_id", "piece", "component")
    return found.join(named, ["scene_id", "piece"]).select("scene_id", "y", "x", "component")


def _number(y, x):  # noqa: ANN001, ANN202
    """A pixel's number: its row, then its column (2 ** 31 of them at most)."""
    return y * (1 << 31) + x


_CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def outlines(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """(scene_id, y, x, label): pixels of a label above 0 that have not all eight neighbours of it (as raster.boundary(), but tile by tile)."""

    def edge(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        image = np.zeros((tile + 2, tile + 2), np.int64)
        y, x, row, _ = unpacked(p, ty * tile - 1, tx * tile - 1, tile + 2)
        image[y, x] = p["label"].to_numpy()[row]
        core = image[1:-1, 1:-1]
        alike = np.logical_and.reduce([image[i : i + tile, j : j + tile] == core for i in range(3) for j in range(3)])
        y, x = np.nonzero((core > 0) & ~alike)
        return pd.DataFrame({"scene_id": scene, "y": y + ty * tile, "x": x + tx * tile, "label": core[y, x]})

    return words_tiled(packed(labels.where("label > 0")).drop("n"), 1, tile).groupBy("scene_id", "ty", "tx").applyInPandas(edge, "scene_id bigint, y bigint, x bigint, label bigint")


def enclosed_regions(score: DataFrame, extent: DataFrame, threshold: float, least: int, most: int, enclosure: float, tile: int = TILE) -> DataFrame:
    """(scene_id, component, area, cy, cx, radius, enclosure, score) of the regions that ridges close in.

    score (scene_id, y, x, score): what has no row has 0.  A ridge is a pixel of ``threshold`` or more, closed by one step of growth; a
    region is a component of the rest that does not touch the frame of the image (extent: scene_id, height, width).  Kept are areas from least to
    most pixels around which at least ``enclosure`` of the neighbouring pixels are ridge before the growth.

    A tile closes its ridges, numbers the pieces of its rest and hands on their sums.  Besides, only the places where pieces meet across a border
    and the neighbouring pixels that may count for two pieces of a region (at the border, or between two pieces) go on as rows.
    """

    def pieces(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        height, width = p["height"].max(), p["width"].max()
        if not height > 0 or not width > 0:  # outside the image
            return pd.DataFrame([], columns=names)
        at, v = (np.concatenate([np.asarray(a, dtype) for a in p[c]]) for c, dtype in (("at", np.int64), ("v", float)))
        values, ridge = (np.zeros((tile + 4) ** 2, dtype) for dtype in (float, bool))
        values[at], ridge[at[~(v < threshold)]] = v, True
        values, ridge = values.reshape(tile + 4, -1)[2:-2, 2:-2], ridge.reshape(tile + 4, -1)
        closed = ridge[1:-1, 1:-1] | ridge[:-2, 1:-1] | ridge[2:, 1:-1] | ridge[1:-1, :-2] | ridge[1:-1, 2:]
        ridge = ridge[1:-1, 1:-1]
        # From here on, squares reach one pixel beyond the tile.
        gy, gx = (np.arange(-1, tile + 1) + t * tile for t in (ty, tx))
        rest = ~closed & ((gy >= 0) & (gy < height))[:, None] & ((gx >= 0) & (gx < width))
        core = rest[1:-1, 1:-1]
        y, x = np.nonzero(core)
        first, own = np.unique(first_of_piece(core)[y, x], return_inverse=True)
        k = len(first)
        name = _number(first // tile + ty * tile, first % tile + tx * tile)
        y, x = y + 1, x + 1
        piece = np.full(rest.shape, -1)
        piece[y, x] = own
        frame = (gy[y] == 0) | (gx[x] == 0) | (gy[y] == height - 1) | (gx[x] == width - 1)
        total = lambda w: np.bincount(own, weights=w, minlength=k)
        # Neighbours that are not of the rest: those that count for one piece only are counted here.
        side = tile + 2
        pair = np.unique(np.concatenate([(own * side + y + i) * side + x + j for i, j in _CROSS[1:]]))
        of, q = np.divmod(pair, side * side)
        of, qy, qx = (c[~rest.ravel()[q]] for c in (of, q // side, q % side))
        shared = np.bincount(qy * side + qx, minlength=side * side)[qy * side + qx] > 1
        alone = ~shared & (qy > 1) & (qy < tile) & (qx > 1) & (qx < tile)
        on = ridge[qy, qx].astype(np.int64)
        out = [pd.DataFrame({"kind": 0, "piece": name, "at": 0, "area": np.bincount(own, minlength=k), "sy": total(gy[y]), "sx": total(gx[x]), "frame": total(frame) > 0, "score": total(values[core]),
                             "n": np.bincount(of[alone], minlength=k), "ridges": np.bincount(of[alone], weights=on[alone], minlength=k).astype(np.int64)})]
        out.append(pd.DataFrame({"kind": 2, "piece": name[of[~alone]], "at": _number(gy[qy], gx[qx])[~alone], "n": 1, "ridges": on[~alone]}))
        # Stretches along which the rest goes on across a border, by their first pixel on the far side of it: the tiles on both sides name the same.
        for axis, (far, inner, here) in enumerate(((rest, rest, piece), (rest.T, rest.T, piece.T))):
            for a, b, line in ((1, 0, 1), (tile, tile + 1, tile + 1)):
                both = inner[a, 1:-1] & far[b, 1:-1]
                start = np.nonzero(both & ~np.append(False, both[:-1]))[0] + 1
                place = _number(gy[line], gx[start]) if axis == 0 else _number(gy[start], gx[line])
                out.append(pd.DataFrame({"kind": 1, "piece": name[here[a, start]], "at": place * 2 + axis}))
        done = pd.concat(out).assign(scene_id=scene)[list(names)]
        return done.fillna({c: 0 for c in names if c != "frame"}).assign(frame=done["frame"] == True)  # noqa: E712

    names = ("scene_id", "kind", "piece", "at", "area", "sy", "sx", "frame", "score", "n", "ridges")
    schema = "scene_id bigint, kind int, piece bigint, at bigint, area bigint, sy double, sx double, frame boolean, score double, n bigint, ridges bigint"
    whole = extent.select(F.col("scene_id").cast("long").alias("scene_id"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width")).where("height > 0 and width > 0")
    for t, v in (("ty", "height"), ("tx", "width")):
        whole = whole.withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(v) - 1) / tile))))
    dealt = blocks(score, "score", 2, tile).unionByName(whole.withColumns({"at": F.array().cast("array<int>"), "v": F.array().cast("array<double>")}), allowMissingColumns=True)
    found = cut(dealt.groupBy("scene_id", "ty", "tx").applyInPandas(pieces, schema), "pieces")
    met = found.where("kind = 1").groupBy("scene_id", "at").agg(F.min("piece").alias("one"), F.max("piece").alias("two")).where("one <> two")
    groups = components(met.select(F.struct("scene_id", F.col("one").alias("piece")).alias("a"), F.struct("scene_id", F.col("two").alias("piece")).alias("b")))
    groups = groups.select("node.scene_id", "node.piece", F.col("component.piece").alias("component"))
    named = found.where("kind <> 1").join(groups.hint("merge"), ["scene_id", "piece"], "left").withColumn("component", F.coalesce("component", "piece"))
    named = cut(named.drop("piece"), "regions")
    key = ["scene_id", "component"]
    per = lambda c: F.sum(c) / F.sum("area")
    size = named.where("kind = 0").groupBy(*key).agg(F.sum("area").alias("area"), per("sy").alias("cy"), per("sx").alias("cx"), F.max("frame").alias("frame"), per("score").alias("score"), F.sum("n").alias("n"), F.sum("ridges").alias("ridges"))
    size = size.where(~F.col("frame") & F.col("area").between(least, most)).drop("frame")
    rim = named.where("kind = 2").groupBy(*key, "at").agg(F.max("ridges").alias("ridges")).groupBy(*key).agg(F.count(F.lit(1)).alias("n2"), F.sum("ridges").alias("ridges2"))
    out = size.join(rim.hint("merge"), key, "left").withColumn("enclosure", (F.col("ridges") + F.coalesce("ridges2", F.lit(0))) / (F.col("n") + F.coalesce("n2", F.lit(0))))
    return out.where(F.col("enclosure") >= enclosure).select(*key, "area", "cy", "cx", "enclosure", "score", F.sqrt(F.col("area") / 3.141592653589793).alias("radius"))


#: Sides of a pixel in the order in which a ring goes round it, label on the right: (step along the side), (step across it).
_ALONG = ((0, 1), (1, 0), (0, -1), (-1, 0))
_ACROSS = ((-1, 0), (0, 1), (1, 0), (0, -1))


def cracks(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Every side of a labelled pixel at which its label ends, as far as one tile can follow its ring.

    Labels are four-connected: at a corner where a label meets itself only diagonally the ring stays with its pixel.  A tile with the pixels around it
    knows the side that follows each of its own: rings within it are closed, the others are runs from where they enter to where they leave.
    scene_id, label, y, x, side; head: the first side of the run (of a closed ring, its least by number), pos: steps from there, closed; of the whole run:
    its length and area (in pixels), its least side (low), the steps to that (at), and the side that follows (next).
    """

    def runs(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        image = np.zeros((tile + 2, tile + 2), np.int64)  # a frame from the tiles around
        y, x, row, _ = unpacked(p, ty * tile - 1, tx * tile - 1, tile + 2)
        image[y, x] = p["label"].to_numpy()[row]
        core, found = image[1:-1, 1:-1], []
        for side in range(4):
            (ay, ax), (cy, cx) = _ALONG[side], _ACROSS[side]
            y, x = np.nonzero((core > 0) & (image[1 + cy : 1 + cy + tile, 1 + cx : 1 + cx + tile] != core))
            own = core[y, x]
            turns = image[1 + y + ay, 1 + x + ax] != own
            straight = ~turns & (image[1 + y + ay + cy, 1 + x + ax + cx] != own)
            back = ~turns & ~straight
            after = np.where(turns, (side + 1) % 4, np.where(straight, side, (side + 3) % 4))
            found.append((own, y, x, np.full(len(y), side), y + ~turns * ay + back * cy, x + ~turns * ax + back * cx, after))
        label, y, x, side, ny, nx, nside = (np.concatenate(c) for c in zip(*found, strict=True))
        number = lambda y, x, side: _number(y + ty * tile, x + tx * tile) * 4 + side
        name, following = number(y, x, side), number(ny, nx, nside)
        n = len(y)
        index = np.full((tile + 2, tile + 2, 4), n)  # n: outside
        index[y + 1, x + 1, side] = np.arange(n)
        after = np.append(index[ny + 1, nx + 1, nside], n)
        rounds = int(n).bit_length()
        far, low = after.copy(), np.append(name, np.iinfo(np.int64).max)
        for _ in range(rounds):
            low, far = np.minimum(low, low[far]), far[far]
        closed = far[:n] < n
        before = np.arange(n + 1)
        before[after[:n]] = np.arange(n)
        first = (closed & (low[:n] == name)) | (before[:n] == np.arange(n))
        before[:n][first] = np.nonzero(first)[0]
        before, pos = before[:n], (~first).astype(np.int64)
        for _ in range(rounds):
            pos, before = pos + pos[before], before[before]
        # Runs as a whole, at their first side.
        order = np.lexsort((pos, before))
        start = np.nonzero(pos[order] == 0)[0]
        at = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        across = np.where(side == 1, x + tx * tile + 0.5, np.where(side == 3, 0.5 - (x + tx * tile), 0.0))[order]
        out = pd.DataFrame({"scene_id": scene, "label": label[order], "y": y[order] + ty * tile, "x": x[order] + tx * tile, "side": side[order]})
        out["head"], out["pos"], out["closed"] = name[before[order]], pos[order], closed[order]
        if n:
            least, size = np.minimum.reduceat(name[order], start), np.diff(np.append(start, n))
            whole = {"length": size, "area": np.add.reduceat(across, start), "low": least}
            whole |= {"at": pos[order][name[order] == least[at]], "next": following[order][np.append(start[1:], n) - 1]}
        return out.assign(**({k: v[at] for k, v in whole.items()} if n else dict.fromkeys(("length", "area", "low", "at", "next"), pos)))

    schema = "scene_id bigint, label bigint, y bigint, x bigint, side int, head bigint, pos bigint, closed boolean, length bigint, area double, low bigint, at bigint, next bigint"
    return words_tiled(packed(labels.where("label > 0")).drop("n"), 1, tile).groupBy("scene_id", "ty", "tx").applyInPandas(runs, schema)


def label_contours(labels: DataFrame, pixel: float = 1.0, tile: int = TILE) -> DataFrame:
    """(scene_id, label, ring, ord, vertex_x, vertex_y, length, area): every ring of every label, a vertex in the middle of each pixel side.

    Positions are those of pixel centres, times ``pixel``; rings go on from their first side by number.  area: of the pixels within the ring, in
    squares of pixel's unit; below 0 for a hole.  Rings that cross tiles are runs of sides, linked by pointer jumping, all at once, in as many steps as
    the logarithm of the most runs of a ring.
    """
    sides = cut(cracks(labels, tile), "cracks")
    runs = sides.where("pos = 0 and not closed").select("scene_id", "head", "next", "length", "area", "low", "at")
    # span: sides from the head to next; off: from the head to the least side in between.
    walk = cut(runs.select("scene_id", "head", "next", "low", F.col("at").alias("off"), F.col("length").alias("span")), "walk")
    while True:
        ahead = walk.select("scene_id", F.col("head").alias("next"), F.col("next").alias("far"), F.col("low").alias("low2"), F.col("off").alias("off2"), F.col("span").alias("span2"))
        better = F.col("low2") < F.col("low")
        j = walk.join(ahead.hint("merge"), ["scene_id", "next"]).select(
            "scene_id", "head", F.col("far").alias("next"), F.least("low", "low2").alias("low"), F.when(better, F.col("off2") + F.col("span")).otherwise(F.col("off")).alias("off"),
            (F.col("span") + F.col("span2")).alias("span"), better.alias("moved"),
        )
        j = cut(j, "walk")
        walk = j.drop("moved")
        if j.where("moved").isEmpty():
            break
    walk = walk.select("scene_id", "head", F.col("low").alias("ring"), "off")
    whole = runs.join(walk.hint("merge"), ["scene_id", "head"]).groupBy("scene_id", "ring").agg(F.sum("length").alias("length"), F.sum("area").alias("area"))
    walk = cut(walk.join(whole.hint("merge"), ["scene_id", "ring"]), "rings")
    side = ["scene_id", "label", "y", "x", "side", "head", "pos"]
    crossing = sides.where("not closed").select(*side).join(walk.hint("merge"), ["scene_id", "head"]).withColumn("ord", F.pmod(F.col("pos") - F.col("off"), F.col("length")))
    inner = sides.where("closed").select(*side, "length", "area", F.col("head").alias("ring"), F.col("pos").alias("ord"), F.lit(0).cast("long").alias("off"))
    half = lambda k: F.element_at(F.array(*(F.lit(v[k] / 2) for v in _ACROSS)), F.col("side") + 1)
    return crossing.unionByName(inner).select(
        "scene_id", "label", "ring", "ord", ((F.col("x") + half(1)) * pixel).alias("vertex_x"), ((F.col("y") + half(0)) * pixel).alias("vertex_y"),
        "length", (F.col("area") * pixel * pixel).alias("area"),
    )


def label_polygons(labels: DataFrame, pixel: float = 1.0) -> DataFrame:
    """The contour of each label: its longest ring, of equal ones the first."""
    rings = label_contours(labels, pixel)
    longest = rings.where("ord = 0").groupBy("scene_id", "label").agg(F.min_by("ring", F.struct(-F.col("length"), "ring")).alias("ring"))
    return rings.join(longest, ["scene_id", "label", "ring"]).select("scene_id", "label", "ord", "vertex_x", "vertex_y")


def scene_geometry(labels: DataFrame, pixel: float) -> DataFrame:
    """(scene_id, label, cx, cy, area, nuc_area, n_rings, n_vertices): centre, areas in squares of pixel's unit, and the size of the longest contour.

    labels: scene_id, y, x, label, nucleus (1 where the pixel is the label's nucleus).
    """
    unit, labels = pixel * pixel, cut(labels, "labels")
    g = labels.where("label > 0").groupBy("scene_id", "label").agg((F.avg("x") * pixel).alias("cx"), (F.avg("y") * pixel).alias("cy"), (F.count(F.lit(1)) * unit).alias("area"), (F.sum("nucleus") * unit).alias("nuc_area"))
    rings = label_contours(labels, pixel).where("ord = 0").groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n_rings"), F.max("length").alias("n_vertices"), F.sum("area").alias("ring_area"))
    return g.join(rings, ["scene_id", "label"])


def collect_polygons(geometry: DataFrame, real: DataFrame) -> DataFrame:
    """(label, source, ord, vertex_x, vertex_y): the real ring of a label where there is one, else its contour; both sides have label, ord and a vertex."""
    own = geometry.join(real.select("label").distinct(), "label", "left_anti")
    side = lambda d, name: d.select("label", F.lit(name).alias("source"), F.col("ord").cast("long").alias("ord"), "vertex_x", "vertex_y")
    return side(real, "real").unionByName(side(own, "contour"))
