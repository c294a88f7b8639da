"""Map projections as column expressions on the GRS80 ellipsoid: transverse Mercator, Albers and Lambert conic.

All take degrees and give metres, or back. Formulas are the standard series (J. Snyder, Map Projections - A Working Manual).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltweave.functions.geometry import col

A, INVERSE_FLATTENING = 6378137.0, 298.257222101
_F = 1 / INVERSE_FLATTENING
E2 = _F * (2 - _F)
E = math.sqrt(E2)
EP2 = E2 / (1 - E2)


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float
    lat0: float = 0.0
    k0: float = 0.9996
    x0: float = 500000.0
    y0: float = 0.0


@dataclass(frozen=True)
class Albers:
    lon0: float
    lat0: float
    lat1: float
    lat2: float
    x0: float = 0.0
    y0: float = 0.0


@dataclass(frozen=True)
class Lambert:
    lon0: float
    lat0: float
    lat1: float
    lat2: float
    x0: float = 0.0
    y0: float = 0.0


Projection = TransverseMercator | Albers | Lambert

CONUS_ALBERS = Albers(-96.0, 23.0, 29.5, 45.5)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(zone * 6.0 - 183.0, y0=10_000_000.0 if south else 0.0)


def _arc(lat):
    """Meridian arc from the equator; a number or a column, in radians."""
    sin = F.sin if isinstance(lat, Column) else math.sin
    e4, e6 = E2 * E2, E2**3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * sin(2 * lat) + (15 * e4 / 256 + 45 * e6 / 1024) * sin(4 * lat) - (35 * e6 / 3072) * sin(6 * lat))


def _q(s):
    log = F.log if isinstance(s, Column) else math.log
    return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - E * s) / (1 + E * s)) / (2 * E))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)


def _t(lat):
    if isinstance(lat, Column):
        s = E * F.sin(lat)
        return F.tan(F.lit(math.pi / 4) - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))
    s = E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (E / 2)


def _cone_albers(p: Albers) -> tuple[float, float, float]:
    a, b, o = (math.radians(x) for x in (p.lat1, p.lat2, p.lat0))
    n = (_m(a) ** 2 - _m(b) ** 2) / (_q(math.sin(b)) - _q(math.sin(a))) if a != b else math.sin(a)
    c = _m(a) ** 2 + n * _q(math.sin(a))
    return n, c, A * math.sqrt(c - n * _q(math.sin(o))) / n


def _cone_lambert(p: Lambert) -> tuple[float, float, float]:
    a, b, o = (math.radians(x) for x in (p.lat1, p.lat2, p.lat0))
    n = (math.log(_m(a)) - math.log(_m(b))) / (math.log(_t(a)) - math.log(_t(b))) if a != b else math.sin(a)
    f = _m(a) / (n * _t(a) ** n)
    return n, f, A * f * _t(o) ** n


def forward(p: Projection, lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """x and y in metres."""
    lam, phi = F.radians(col(lon)), F.radians(col(lat))
    if isinstance(p, TransverseMercator):
        n = A / F.sqrt(1 - E2 * F.sin(phi) ** 2)
        t, c, a = F.tan(phi) ** 2, EP2 * F.cos(phi) ** 2, (lam - math.radians(p.lon0)) * F.cos(phi)
        x = n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a**5 / 120)
        y = _arc(phi) - _arc(math.radians(p.lat0)) + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a**6 / 720)
        return F.lit(p.x0) + p.k0 * x, F.lit(p.y0) + p.k0 * y
    if isinstance(p, Albers):
        n, c, r0 = _cone_albers(p)
        r = A * F.sqrt(c - n * _q(F.sin(phi))) / n
    else:
        n, f, r0 = _cone_lambert(p)
        r = A * f * F.pow(_t(phi), F.lit(n))
    turn = n * (lam - math.radians(p.lon0))
    return F.lit(p.x0) + r * F.sin(turn), F.lit(p.y0 + r0) - r * F.cos(turn)


def inverse(p: Projection, x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    x, y = col(x) - p.x0, col(y) - p.y0
    if isinstance(p, TransverseMercator):
        mu = (_arc(math.radians(p.lat0)) + y / p.k0) / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
        e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
        phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
        c, t, w = EP2 * F.cos(phi) ** 2, F.tan(phi) ** 2, 1 - E2 * F.sin(phi) ** 2
        n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, F.lit(1.5))
        d = x / (n * p.k0)
        lat = phi - n * F.tan(phi) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * d**6 / 720)
        lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * d**5 / 120) / F.cos(phi)
        return F.degrees(lon) + p.lon0, F.degrees(lat)
    n, k, r0 = _cone_albers(p) if isinstance(p, Albers) else _cone_lambert(p)
    sign = 1.0 if n >= 0 else -1.0
    r = sign * F.sqrt(x * x + (r0 - y) * (r0 - y))
    lon = F.degrees(F.atan2(sign * x, sign * (r0 - y)) / n) + p.lon0
    e4, e6, e8 = E2**2, E2**3, E2**4
    if isinstance(p, Lambert):  # from the conformal latitude
        chi = F.lit(math.pi / 2) - 2 * F.atan(F.pow(r / (A * k), F.lit(1 / n)))
        series = (E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    else:  # from the authalic latitude
        q = (k - r * r * n * n / (A * A)) / n
        chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _q(1.0))))
        series = (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    phi = chi
    for i, c in enumerate(series):
        phi = phi + c * F.sin(2 * (i + 1) * chi)
    return lon, F.degrees(phi)


def project_points(line: Column | str, p: Projection, back: bool = False) -> Column:
    """An array of points, each vertex projected."""

    def move(v: Column) -> Column:
        x, y = (inverse if back else forward)(p, v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(col(line), move)


def looks_projected(minx: Column | str, maxx: Column | str) -> Column:
    """Whether coordinates can't be degrees."""
    return (F.abs(col(minx)) > 180) | (F.abs(col(maxx)) > 180)
