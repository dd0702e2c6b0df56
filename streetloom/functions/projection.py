"""WGS84 degrees to UTM metres and back as Columns: Krueger's series of the transverse Mercator projection, to the fourth order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and UTM.
_A, _F, K0, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = _F / (2 - _F)
_E = 2 * math.sqrt(_N) / (1 + _N)
_R = K0 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(rows: tuple[tuple[float, ...], ...]) -> list[float]:
    """Sums of coefficients times powers of n from 1."""
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows]


_ALPHA = _series(((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280)))
_BETA = _series(((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280)))
_DELTA = _series(((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630)))


def zone(lon: float) -> int:
    return min(60, max(1, int((lon + 180) // 6) + 1))


def to_utm(lon: Column, lat: Column, zone_number: int, south: bool = False) -> tuple[Column, Column]:
    """x, y in metres; lon and lat in degrees, near the zone."""
    lam, phi = F.radians(lon - F.lit(zone_number * 6.0 - 183.0)), F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + _R * x, (SOUTH if south else 0.0) + _R * y


def to_degrees(x: Column, y: Column, zone_number: int, south: bool = False) -> tuple[Column, Column]:
    """lon, lat in degrees."""
    xi, eta = (y - (SOUTH if south else 0.0)) / _R, (x - EAST) / _R
    up, side = xi, eta
    for j, b in enumerate(_BETA, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        side = side - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(side))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(side), F.cos(up))) + F.lit(zone_number * 6.0 - 183.0), F.degrees(phi)
