"""Scalar expressions: coordinates, kernel, angles, decoding, classes and closed-form scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 3.0
ALPHA, BETA = 0.2, 0.8


@dataclass(frozen=True)
class GridSpec:
    """Rows, columns, upper left corner and pixel size of a north-up grid."""

    height: int
    width: int
    x0: float
    y0: float
    pixel: float


def rc_to_xy(r: Column, c: Column, g: GridSpec) -> tuple[Column, Column]:
    """Centre of a pixel."""
    return g.x0 + (c + 0.5) * g.pixel, g.y0 - (r + 0.5) * g.pixel


def xy_to_rc(x: Column, y: Column, g: GridSpec) -> tuple[Column, Column]:
    """Pixel that holds a point (by floor)."""
    return F.floor((g.y0 - y) / g.pixel).cast("int"), F.floor((x - g.x0) / g.pixel).cast("int")


def xy_to_lonlat(x: Column, y: Column, zone: int = 11) -> tuple[Column, Column]:
    """Inverse transverse Mercator series on the WGS84 ellipsoid, northern hemisphere, in degrees."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep2 = e2 / (1 - e2)
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    c1, t1 = ep2 * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2)
    w = 1 - e2 * F.pow(F.sin(p), 2)
    n1, r1 = a / F.sqrt(w), a * (1 - e2) / F.pow(w, 1.5)
    d = (x - 500000.0) / (n1 * k0)
    lat = p - (n1 * F.tan(p) / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * F.pow(d, 5) / 120) / F.cos(p)
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def kernel(d2: Column, radius: float = RADIUS) -> Column:
    """Triangular kernel of a squared distance: max(1 - d / radius, 0)."""
    return F.greatest(1 - F.sqrt(d2) / radius, F.lit(0.0))


def strike(dr: Column, dc: Column) -> Column:
    """Azimuth of a step, clockwise from north, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(dc.cast("double"), -dr.cast("double"))) + 360, F.lit(180.0))


def half_turn(a: Column, b: Column) -> Column:
    """Difference of two strikes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def valid(v: Column) -> Column:
    """Finite and below the sentinel."""
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e30), F.lit(False))


def decode_sqrt_rank(q: Column) -> Column:
    return F.when(q > 0, F.pow(F.least(F.greatest((q - 1) / 254.0, F.lit(0.0)), F.lit(1.0)), 2)).otherwise(0.0)


def decode_linear_rank(q: Column) -> Column:
    return F.when(q > 0, F.least(F.greatest((q - 1) / 254.0, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def tversky(tp: Column, fp: Column, n: Column, eps: float = 1e-7) -> Column:
    """Distance-weighted Tversky index; 0 without truth."""
    return F.when(n == 0, 0.0).otherwise(tp / (tp + ALPHA * fp + BETA * (n - tp) + eps))


def inclusion_threshold(score: Column) -> Column:
    """Credit per unit of false positive above which adding a dot raises the score."""
    return ALPHA * score / (1 - ALPHA * score)


def credit_required(target: Column, dots: Column, n: Column) -> Column:
    """True-positive credit that reaches a target score with so many dots, each dot worth one unit."""
    return target * (ALPHA * dots + BETA * n) / (1 - target * (1 - ALPHA - BETA))


def review_class(same_feature: Column, same_name: Column, compatible: Column) -> Column:
    return F.when(same_feature, "same_feature").when(same_name, "same_name").when(compatible, "compatible").otherwise("unrelated")


OPPOSITE = {"N": "S", "S": "N", "E": "W", "W": "E", "NE": "SW", "SW": "NE", "NW": "SE", "SE": "NW"}


def kinematic_compatible(slip_a: Column, slip_b: Column, dip_a: Column, dip_b: Column) -> Column:
    """Equal known slip senses whose dips, where both are known, are not opposite."""
    opposite = F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair])
    against = F.coalesce(F.try_element_at(opposite, dip_a) == dip_b, F.lit(False))
    return F.coalesce(slip_a == slip_b, F.lit(False)) & ~against


def score_of(*tests: Column) -> Column:
    """How many tests hold; null counts as no."""
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def is_duplicate(overlap: Column, rho: Column | None = None, most_overlap: float = 0.70, most_rho: float = 0.90) -> Column:
    """Whether a candidate counts as a copy: strictly above either bound; an unknown correlation does not."""
    much = F.coalesce(overlap > most_overlap, F.lit(False))
    return much if rho is None else much | F.coalesce(F.abs(rho) > most_rho, F.lit(False))


def credit_fraction(score: Column, dots_per_truth: Column) -> Column:
    """Share of the truth's credit that a score implies at so many dots a truth cell, where both sides' credits are equal."""
    return score * (BETA + ALPHA * dots_per_truth)


def truth_from_blind(score: Column, dots: Column, credit: Column, matched: Column) -> Column:
    """Truth size that a blind probe's score implies: credit and matched dots per truth cell are known, the rest is linear."""
    return score * ALPHA * dots / (credit - score * (ALPHA * (credit - matched) + BETA))


def forward_score(tp: Column, dots: Column, crowding: Column, truth: Column) -> Column:
    """Score of a credit, a number of dots, their crowding (matched mass over credit) and a truth size."""
    return tp / (ALPHA * tp * (1 - crowding) + ALPHA * dots + BETA * truth)
