"""Distances, the UTM zone 30N projection and edge predicates as Column arithmetic."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..fixed_values import EARTH_RADIUS_KM

# GRS80 ellipsoid and zone 30N parameters (public constants).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = -3.0, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger series to the fourth order of the third flattening: below a tenth of a millimetre here.
FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
           13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
           61 * _N**3 / 240 - 103 * _N**4 / 140,
           49561 * _N**4 / 161280]
INVERSE = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
           _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
           17 * _N**3 / 480 - 37 * _N**4 / 840,
           4397 * _N**4 / 161280]
# Beyond this distance from the central meridian nothing can lie near a zone 30 area.
MAX_MERIDIAN_DEGREES = 80.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; rounding past the antipode counts as the antipode."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((b - a) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.nanvl(F.asin(F.sqrt(h)), F.lit(math.pi / 2))


def usable_coordinates(lat: Column, lon: Column) -> Column:
    """Present, finite and within +-90 / +-180; never NULL."""
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def project_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; NULL for unusable or far-away coordinates."""
    near = usable_coordinates(lat, lon) & (F.abs(lon - CENTRAL_MERIDIAN) <= MAX_MERIDIAN_DEGREES) & (F.abs(lat) < 89.9)
    phi = F.when(near, F.radians(lat))
    lam = F.when(near, F.radians(lon - CENTRAL_MERIDIAN))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, a in enumerate(FORWARD, start=1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EASTING + SCALE * RECTIFYING * east, SCALE * RECTIFYING * north


def unproject_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees from zone 30N metres."""
    xi = y / (SCALE * RECTIFYING)
    eta = (x - FALSE_EASTING) / (SCALE * RECTIFYING)
    u, v = xi, eta
    for j, b in enumerate(INVERSE, start=1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    tau = F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u))
    # Newton-free inversion of the isometric latitude: three fixed-point steps reach double precision.
    isometric = F.asinh(tau)
    s = F.tanh(isometric)
    for _ in range(6):
        s = F.tanh(isometric + ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    return F.degrees(F.asin(s)), F.degrees(F.atan2(F.sinh(v), F.cos(u))) + CENTRAL_MERIDIAN


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """Planar distance from a point to the edge e<x1,y1,x2,y2>."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = dx * dx + dy * dy
    along = ((x - e["x1"]) * dx + (y - e["y1"]) * dy)
    u = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(along, length2))), F.lit(0.0))
    return F.hypot(x - (e["x1"] + u * dx), y - (e["y1"] + u * dy))


def crosses_ray(x: Column, y: Column, e: Column) -> Column:
    """The ray from the point towards +x crosses the edge."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
    return spans & (x < at)


def on_edge(x: Column, y: Column, e: Column) -> Column:
    """The point lies exactly on the edge."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return ((cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
