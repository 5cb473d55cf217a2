"""Column expressions: kernels, angles, small eigenproblems, projections and score algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 3.0
ALPHA, BETA, EPS = 0.2, 0.8, 1e-9


def kernel(d: Column, radius: float = RADIUS) -> Column:
    """Triangular kernel of a distance in cells."""
    return F.greatest(1 - d / radius, F.lit(0.0))


def tversky(tp: Column, fp: Column, fn: Column, alpha: float = ALPHA, beta: float = BETA, eps: float = EPS) -> Column:
    return tp / (tp + alpha * fp + beta * fn + eps)


def axial_difference(a: Column, b: Column, period: float = 180.0) -> Column:
    """Least difference of two axes (angles that repeat after half a turn)."""
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Larger and smaller eigenvalue of [[a, b], [b, c]] and the larger one's angle."""
    mean, half = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, F.lit(2.0)) + b * b)
    return mean + half, mean - half, 0.5 * F.atan2(2 * b, a - c)


def azimuth(ux: Column, uy: Column) -> Column:
    """Compass direction of an axis, degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(ux, uy)), F.lit(180.0))


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def decode_linear(q: Column, low: float, high: float) -> Column:
    """Byte layers: 0 is no data, 1 to 255 span low to high."""
    return F.when(q > 0, low + (q - 1) / 254.0 * (high - low))


def decode_square(q: Column, high: float) -> Column:
    """Byte layers coded by square root."""
    return F.when(q > 0, F.pow((q - 1) / 254.0, F.lit(2.0)) * high)


def clean(v: Column) -> Column:
    """NaN to null, so that aggregates skip it."""
    return F.when(~F.isnan(v), v)


def krueger() -> tuple[float, float, tuple[float, ...]]:
    """Eccentricity, rectifying radius times the scale of the central meridian, and the series' coefficients (GRS80)."""
    f, a = 1 / 298.257222101, 6378137.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # fixed values: the series' coefficients
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    return 2 * math.sqrt(n) / (1 + n), 0.9996 * big_a, alpha


def utm(lon: Column, lat: Column, central: float = -117.0) -> tuple[Column, Column]:
    """Easting and northing on the GRS80 ellipsoid by the Krueger series to the sixth power of n."""
    e, radius, alpha = krueger()
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return 500000.0 + radius * east, radius * north


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """Deterministic uniform number in (0, 1) from the columns: 52 bits of the MD5 of seed and values, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def eigen3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, descending, by the trigonometric form."""
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))
    phi = F.acos(clip(r, -1.0, 1.0)) / 3
    low, high = mean + 2 * p * F.cos(phi + 2 * math.pi / 3), mean + 2 * p * F.cos(phi)
    return high, 3 * mean - high - low, low


def normal3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Unit vector of the least eigenvalue: the longest cross product of two rows of the matrix less that value."""
    low = eigen3(xx, xy, xz, yy, yz, zz)[2]
    rows = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    vectors = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sized = F.array(*[F.struct((x * x + y * y + z * z).alias("s"), F.lit(-i).alias("i"), x.alias("x"), y.alias("y"), z.alias("z")) for i, (x, y, z) in enumerate(vectors)])
    best = F.array_max(sized)
    length = F.sqrt(best["s"])
    return best["x"] / length, best["y"] / length, best["z"] / length
