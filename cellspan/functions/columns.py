"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def lut_normalize(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) within [0, 1]; a span of 1 where high is not above low."""
    return clip((v - low) / F.when(high > low, high - low).otherwise(1.0), 0.0, 1.0)


def overlap(low: Column, high: Column, a: Column, b: Column) -> Column:
    """Length that the intervals [low, high] and [a, b] share."""
    return F.greatest(F.lit(0.0), F.least(high, b) - F.greatest(low, a))


def tilt_z(extent: Column, volume: float = 130.0, elongation: float = 3.6) -> Column:
    """Share of the long axis that points along z, in [0.1, 1], from the extent along z of an ellipsoid of that volume."""
    radius = (3 * volume / (4 * math.pi * elongation)) ** (1 / 3)
    return clip(extent / (2 * elongation * radius), 0.1, 1.0)


def section_state(area: Column, nucleus: Column, aspect: Column, edge: Column, small_below: Column) -> Column:
    """How a section cuts a cell; the order of the cases counts.  edge: share of its outline on the border."""
    share, bare, small = nucleus / area, nucleus <= 0, area < small_below
    # The states' thresholds.
    return (
        F.when(area <= 0, "unknown").when(~bare & (share > 0.6), "nucleus_rich").when(~bare & share.between(0.2, 0.6) & (edge < 0.05), "full")
        .when(small & (aspect > 3.0), "sliver").when(bare & small, "membrane_only").when(bare | (share < 0.1), "nucleus_poor").otherwise("full")
    )


def ridge_object(area: Column, distance: Column, overlap: Column, near: Column) -> Column:
    """What a membrane ridge is; the order of the cases counts."""
    # The classes' thresholds.
    return (
        F.when(area <= 12, "debris_or_puncta").when(near | (distance <= 3.0), "boundary_offset").when(overlap > 0.1, "membrane_only_or_sliver_near_nucleus")
        .when(distance <= 12.0, "out_of_plane_membrane").otherwise("unassigned_membrane_ridge")
    )


def assigned(cell_id: Column) -> Column:
    """True where a molecule has a cell; the names that stand for none are fixed values."""
    return F.coalesce(~cell_id.isin("", "0", "cell_0", "UNASSIGNED", "None", "nan"), F.lit(False))


def packed_cell_id(prefix: Column, suffix: Column) -> Column:
    """The written form of a packed id: eight letters a to p for the hex digits of prefix, a dash, suffix."""
    digits = F.lpad(F.lower(F.hex(prefix)), 8, "0")
    return F.concat(F.translate(digits, "0123456789abcdef", "abcdefghijklmnop"), F.lit("-"), suffix.cast("string"))


def in_box_halfopen(x: Column, y: Column) -> Column:
    return (x >= F.col("xmin")) & (x < F.col("xmax")) & (y >= F.col("ymin")) & (y < F.col("ymax"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def normal_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


#: The coefficients of Lanczos' series for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x above 0."""
    z = x - 1
    t = z + 7.5
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def beta_share(x: Column, a: Column, b: Column, terms: int = 250) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction on the side where that is quick."""
    flip = x >= (a + 1) / (a + b + 2)
    p, q, u = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        """Two links of the fraction: numerators of even and odd number."""
        even = m * (s["q"] - m) * s["u"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m))
        d, c = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
        h = s["h"] * d * c
        odd = -(s["p"] + m) * (s["p"] + s["q"] + m) * s["u"] / ((s["p"] + 2 * m) * (s["p"] + 2 * m + 1))
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["u"].alias("u"), c.alias("c"), d.alias("d"), (h * d * c).alias("h"))

    d0 = 1 / safe(1 - (p + q) * u / (p + 1))
    start = F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), u.cast("double").alias("u"), F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["h"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.ln(u) + q * F.ln(1 - u)) / p
    share = F.when(u <= 0, 0.0).otherwise(front * fraction)
    return F.when(flip, 1 - share).otherwise(share)


def student_tail(t: Column, df: Column, most: float = 20_000.0) -> Column:
    """P(T > t) of Student's distribution with df degrees of freedom; beyond ``most`` the normal tail at the matching place."""
    small = F.least(df, F.lit(most))
    upper = 0.5 * beta_share(small / (small + t * t), small / 2, F.lit(0.5))
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > most, normal_tail(z)).when(t >= 0, upper).otherwise(1 - upper)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(k or more of n) by the normal approximation, without correction; 1 without trials; where nothing varies 1 up to the mean, else 1e-12."""
    mean, deviation = n * p, F.sqrt(n * p * (1 - p))
    return F.when(n <= 0, 1.0).when(deviation == 0, F.when(k <= mean, 1.0).otherwise(1e-12)).otherwise(normal_tail((k - mean) / deviation))
