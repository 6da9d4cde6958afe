"""Universal transverse Mercator (WGS84) to metres and back, as columns and as plain Python.

The series are Krüger's, to the sixth order of the third flattening: well under a millimetre within a
zone.  Only the northern hemisphere's zones are needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
A, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
#: Coordinate system of each kind of data.
ZONES = {"EPSG:32650": 50, "EPSG:32629": 29, "EPSG:32634": 34}
DATASET_CRS = {"tdrive": "EPSG:32650", "porto": "EPSG:32629", "ais": "EPSG:32634"}

N = FLATTENING / (2 - FLATTENING)
E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# Krüger's coefficients, forward and inverse.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)


def central_meridian(crs: str) -> float:
    if crs not in ZONES:
        raise ValueError(f"unknown coordinate system {crs}")
    return ZONES[crs] * 6 - 183.0


def to_metres(lon: float, lat: float, crs: str = "EPSG:32650") -> tuple[float, float]:
    phi, lam = math.radians(lat), math.radians(lon - central_meridian(crs))
    t = math.sinh(math.atanh(math.sin(phi)) - E * math.atanh(E * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def to_degrees(x: float, y: float, crs: str = "EPSG:32650") -> tuple[float, float]:
    xi0, eta0 = y / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)
    xi = xi0 - sum(b * math.sin(2 * j * xi0) * math.cosh(2 * j * eta0) for j, b in enumerate(BETA, 1))
    eta = eta0 - sum(b * math.cos(2 * j * xi0) * math.sinh(2 * j * eta0) for j, b in enumerate(BETA, 1))
    tau_conformal = math.sin(xi) / math.hypot(math.sinh(eta), math.cos(xi))
    tau = tau_conformal
    for _ in range(6):  # Newton's steps for the geographic from the conformal latitude
        sigma = math.sinh(E * math.atanh(E * tau / math.hypot(1, tau)))
        t = tau * math.hypot(1, sigma) - sigma * math.hypot(1, tau)
        tau += (tau_conformal - t) / math.hypot(1, t) * (1 + (1 - E * E) * tau * tau) / ((1 - E * E) * math.hypot(1, tau))
    return central_meridian(crs) + math.degrees(math.atan2(math.sinh(eta), math.cos(xi))), math.degrees(math.atan(tau))


def metres(lon: Column, lat: Column, crs: str = "EPSG:32650") -> tuple[Column, Column]:
    """x and y columns of longitude and latitude columns."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(crs))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def envelope(min_lon: float, min_lat: float, max_lon: float, max_lat: float, crs: str = "EPSG:32650") -> tuple[float, float, float, float]:
    """min x, min y, max x, max y of the four projected corners."""
    corners = [to_metres(lon, lat, crs) for lon in (min_lon, max_lon) for lat in (min_lat, max_lat)]
    xs, ys = zip(*corners)
    return min(xs), min(ys), max(xs), max(ys)
