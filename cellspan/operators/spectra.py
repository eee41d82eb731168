"""Power spectra of square patches of an image, binned by frequency and by direction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators.images import TILE, blocks

#: What is added to a mean power before its logarithm, and to the greatest frequency.
FLOOR, RIM = 1e-8, 1e-9


def frequency_bins(side: int, radial: int, orient: int = 1) -> np.ndarray:
    """The bin (radius * orient + direction) of every coefficient of a real transform of side x side."""
    fy, fx = np.meshgrid(np.fft.fftfreq(side), np.fft.rfftfreq(side), indexing="ij")
    r = np.hypot(fy, fx)
    ring = np.minimum((r / (r.max() + RIM) * radial).astype(int), radial - 1)
    sector = np.minimum((np.mod(np.arctan2(fy, fx), np.pi) / np.pi * orient).astype(int), orient - 1)
    return ring * orient + sector


def log_power(pixels: DataFrame, side: int, radial: int, orient: int = 1) -> DataFrame:
    """(scene_id, py, px, bin, power): ln of the mean power of each bin of each patch of side x side pixels that has a pixel.

    pixels: scene_id, y, x, value, of which what lacks is 0.  bin: radius * orient + direction, as the bins have any coefficient or not.
    Pixels travel as arrays by squares of whole patches; a square's patches are transformed together.
    """
    bins = frequency_bins(side, radial, orient)
    counts = np.maximum(np.bincount(bins.ravel(), minlength=radial * orient), 1)
    n = max(1, TILE // side)  # patches along a square
    edge = n * side

    def transform(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        scene, ty, tx = key
        at, v = (np.concatenate(p[c].to_list()) for c in ("at", "v"))
        image, given = np.zeros(edge * edge), np.zeros(edge * edge, bool)
        image[at], given[at] = v, True
        image, given = (a.reshape(n, side, n, side).swapaxes(1, 2).reshape(n * n, side, side) for a in (image, given))
        there = np.nonzero(given.any(axis=(1, 2)))[0]
        f = np.fft.rfft2(image[there], norm="ortho")
        size = f.real**2 + f.imag**2
        power = np.stack([np.bincount(bins.ravel(), weights=s.ravel(), minlength=radial * orient) / counts for s in size])
        each = lambda a: np.repeat(a, radial * orient)
        return pd.DataFrame({"scene_id": scene, "py": each(ty * n + there // n), "px": each(tx * n + there % n), "bin": np.tile(np.arange(radial * orient), len(there)), "power": np.log(power + FLOOR).ravel()})

    return blocks(pixels, "value", 0, edge).groupBy("scene_id", "ty", "tx").applyInPandas(transform, "scene_id bigint, py bigint, px bigint, bin int, power double")


def anisotropy(polar: DataFrame, radial: int, orient: int) -> DataFrame:
    """(scene_id, py, px, anisotropy): mean log power along the axes less that along the diagonals, over the middle radii.  polar: log_power()."""
    ring, sector = F.floor(F.col("bin") / orient), F.col("bin") % orient
    middle = polar.where((ring >= max(1, radial // 4)) & (ring < max(2, radial - 1)))
    along = lambda *s: F.avg(F.when(sector.isin(*s), F.col("power")))
    return middle.groupBy("scene_id", "py", "px").agg((along(0, orient // 2) - along(orient // 4, 3 * orient // 4)).alias("anisotropy"))
