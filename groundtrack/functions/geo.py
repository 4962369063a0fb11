"""Homographies, transverse Mercator and local frames as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the WGS84 ellipsoid and the scale and false origins of its zones
A, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)


def zone_of(lon: Column, lat: Column) -> Column:
    """EPSG number of the zone of a point."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6).cast("int") + 1


def _axis(epsg: Column) -> Column:
    return F.radians((epsg % 100 - 1) * 6 - 180 + 3)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing, by the Krüger series."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    dl = F.radians(lon) - _axis(epsg)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for k, a in enumerate(_FORTH, 1):
        e = e + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        n = n + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    south = F.when(epsg >= 32700, NORTHING).otherwise(0.0)
    return EASTING + SCALE * _RADIUS * e, south + SCALE * _RADIUS * n


def to_lonlat(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude; the latitude follows from the conformal one by fixed-point steps."""
    south = F.when(epsg >= 32700, NORTHING).otherwise(0.0)
    xi, eta = (north - south) / (SCALE * _RADIUS), (east - EASTING) / (SCALE * _RADIUS)
    x, e = xi, eta
    for k, b in enumerate(_BACK, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        e = e - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asin(F.sin(x) / F.cosh(e))
    base = F.atanh(F.sin(conformal))
    s = F.sin(conformal)
    for _ in range(5):
        s = F.tanh(base + _E * F.atanh(_E * s))
    return F.degrees(_axis(epsg) + F.atan2(F.sinh(e), F.cos(x))), F.degrees(F.asin(s))


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """x', y' and scale of a pixel under a row-major homography of nine numbers."""
    row = lambda i: h[i] * x + h[i + 1] * y + h[i + 2]
    s = row(6)
    return F.try_divide(row(0), s), F.try_divide(row(3), s), s


def two_decimals(x: Column) -> Column:
    return F.rint(x * 100) / 100


def four_points(ab: Column, bc: Column, cd: Column, da: Column, ac: Column) -> list[tuple[Column, Column]]:
    """A local frame from the four sides and one diagonal of a quad: A at 0, C on the x axis, B and D
    on either side of it, by the law of cosines."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))
    b = F.acos(clamp((ab * ab + ac * ac - bc * bc) / (2 * ab * ac)))
    d = F.acos(clamp((da * da + ac * ac - cd * cd) / (2 * da * ac)))
    zero = F.lit(0.0)
    return [(zero, zero), (ab * F.cos(b), -(ab * F.sin(b))), (ac, zero), (da * F.cos(d), da * F.sin(d))]
