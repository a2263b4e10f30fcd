"""Distances and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import Value, col

# The European equal-area projection (centre, false origin, GRS80 ellipsoid).
LAEA_LAT, LAEA_LON = 52.0, 10.0
LAEA_X0, LAEA_Y0 = 4321000.0, 3210000.0
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101


def haversine_km(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    a, b, c, d = (F.radians(col(v)) for v in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((c - a) / 2.0), F.sin((d - b) / 2.0)
    h = half_lat * half_lat + F.cos(a) * F.cos(c) * half_lon * half_lon
    return 2.0 * config.EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def squared_degrees(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """dlat^2 + (dlon cos lat1)^2: what ranks neighbouring cells."""
    dlat = col(lat2) - col(lat1)
    dlon = (col(lon2) - col(lon1)) * F.cos(F.radians(col(lat1)))
    return dlat * dlat + dlon * dlon


def rotated_to_geographic(rlat: Value, rlon: Value, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """Latitude and longitude of a point given in rotated-pole degrees (spherical trigonometry)."""
    a, b = F.radians(col(rlat)), F.radians(col(rlon))
    sin_pole, cos_pole = math.sin(math.radians(pole_lat)), math.cos(math.radians(pole_lat))
    lat = F.asin(F.least(F.greatest(sin_pole * F.sin(a) + cos_pole * F.cos(a) * F.cos(b), F.lit(-1.0)), F.lit(1.0)))
    east = F.cos(a) * F.sin(b)
    north = cos_pole * F.sin(a) - sin_pole * F.cos(a) * F.cos(b)
    lon = F.degrees(F.atan2(-east, north)) + pole_lon
    wrapped = lon - 360.0 * F.floor((lon + 180.0) / 360.0)
    return F.degrees(lat), wrapped


def laea_sphere(lat: Value, lon: Value, centre_lat: float = LAEA_LAT, centre_lon: float = LAEA_LON
                ) -> tuple[Column, Column]:
    """Equal-area coordinates on the unit sphere, x to the east and y to the north."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - centre_lon)
    s, c = math.sin(math.radians(centre_lat)), math.cos(math.radians(centre_lat))
    k = F.sqrt(2.0 / (1.0 + s * F.sin(phi) + c * F.cos(phi) * F.cos(lam)))
    return k * F.cos(phi) * F.sin(lam), k * (c * F.sin(phi) - s * F.cos(phi) * F.cos(lam))


def _authalic(sin_phi: float, e: float) -> float:
    return (1 - e * e) * (sin_phi / (1 - (e * sin_phi) ** 2)
                          - math.log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e))


def laea_to_geographic(x: Value, y: Value) -> tuple[Column, Column]:
    """Geographic degrees of metres in the European equal-area projection (ellipsoid, series form)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    qp = _authalic(1.0, e)
    rq = SEMI_MAJOR * math.sqrt(qp / 2)
    phi0 = math.radians(LAEA_LAT)
    beta0 = math.asin(_authalic(math.sin(phi0), e) / qp)
    d = SEMI_MAJOR * math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2) / (rq * math.cos(beta0))
    dx, dy = (col(x) - LAEA_X0) / d, (col(y) - LAEA_Y0) * d
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2.0 * F.asin(F.least(rho / (2.0 * rq), F.lit(1.0)))
    sin_beta = F.when(rho > 0, F.cos(c) * math.sin(beta0) + dy * F.sin(c) * math.cos(beta0) / rho).otherwise(
        math.sin(beta0))
    beta = F.asin(F.least(F.greatest(sin_beta, F.lit(-1.0)), F.lit(1.0)))
    lat = (beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
           + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta))
    lon = F.atan2(dx * F.sin(c), rho * math.cos(beta0) * F.cos(c) - dy * math.sin(beta0) * F.sin(c))
    lon = F.when(rho > 0, lon).otherwise(0.0)
    return F.degrees(lat), F.degrees(lon) + LAEA_LON
