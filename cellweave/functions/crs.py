"""Coordinate reference systems in closed form, as column expressions.

Known: longitude and latitude (EPSG:4326, 4269), web Mercator (3857), UTM (326zz and 327zz,
and 269zz) by Krueger's series to the fourth order, and the equal-area conic of the
contiguous United States (5070). All go through longitude and latitude; the datums of
4269, 269zz and 5070 are taken as equal to that of 4326, which is good to about a metre.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the length of the web Mercator square's side, in metres.
MERCATOR = 20037508.342789244

# The ellipsoid, and the scale and origin of UTM.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, NORTHING = 0.9996, 500000.0, 10000000.0
# Standard parallels, latitude and longitude of the origin of EPSG:5070.
PARALLELS, ORIGIN = (29.5, 45.5), (23.0, -96.0)

Point = tuple[Column, Column]
Way = Callable[[Column, Column], Point]

_N = FLATTENING / (2 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The series' coefficients in powers of the third flattening, from the second or the first power on.
_FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BACK = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _utm(zone: int, south: bool) -> tuple[Way, Way]:
    centre, north = math.radians(zone * 6 - 183), NORTHING if south else 0.0
    k = 2 * math.sqrt(_N) / (1 + _N)
    size = SCALE * _RADIUS

    def to(lon: Column, lat: Column) -> Point:
        sine, away = F.sin(F.radians(lat)), F.radians(lon) - centre
        t = F.sinh(F.atanh(sine) - k * F.atanh(k * sine))
        x, y = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1.0 + t * t))
        east = y + _sum([c * F.cos(2.0 * j * x) * F.sinh(2.0 * j * y) for j, c in enumerate(_FORWARD, 1)])
        up = x + _sum([c * F.sin(2.0 * j * x) * F.cosh(2.0 * j * y) for j, c in enumerate(_FORWARD, 1)])
        return east * size + EASTING, up * size + north

    def back(east: Column, up: Column) -> Point:
        x, y = (up - north) / size, (east - EASTING) / size
        u = x - _sum([c * F.sin(2.0 * j * x) * F.cosh(2.0 * j * y) for j, c in enumerate(_BACK, 1)])
        v = y - _sum([c * F.cos(2.0 * j * x) * F.sinh(2.0 * j * y) for j, c in enumerate(_BACK, 1)])
        conformal = F.asin(F.sin(u) / F.cosh(v))
        lat = conformal + _sum([c * F.sin(2.0 * j * conformal) for j, c in enumerate(_LATITUDE, 1)])
        return F.degrees(F.atan2(F.sinh(v), F.cos(u)) + centre), F.degrees(lat)

    return to, back


def _mercator() -> tuple[Way, Way]:
    radius = MERCATOR / math.pi

    def to(lon: Column, lat: Column) -> Point:
        return lon * (MERCATOR / 180.0), F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4)) * radius

    def back(x: Column, y: Column) -> Point:
        return x / (MERCATOR / 180.0), F.degrees(F.atan(F.exp(y / radius)) * 2.0 - math.pi / 2)

    return to, back


def _albers() -> tuple[Way, Way]:
    def q_at(sine: float) -> float:
        return (1 - _E2) * (sine / (1 - _E2 * sine * sine) - math.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))

    def m_at(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)

    first, second, lat0 = (math.radians(x) for x in (*PARALLELS, ORIGIN[0]))
    q1, q2, q0, pole = (q_at(math.sin(x)) for x in (first, second, lat0, math.pi / 2))
    cone = (m_at(first) ** 2 - m_at(second) ** 2) / (q2 - q1)
    c = m_at(first) ** 2 + cone * q1
    rho0 = SEMI_MAJOR * math.sqrt(c - cone * q0) / cone
    # The series of the authalic latitude.
    series = [_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360]

    def to(lon: Column, lat: Column) -> Point:
        sine = F.sin(F.radians(lat))
        q = (sine / (1.0 - sine * sine * _E2) - F.log((1.0 - sine * _E) / (1.0 + sine * _E)) / (2 * _E)) * (1 - _E2)
        rho, turn = F.sqrt(c - q * cone) * (SEMI_MAJOR / cone), F.radians(lon - ORIGIN[1]) * cone
        return rho * F.sin(turn), rho0 - rho * F.cos(turn)

    def back(x: Column, y: Column) -> Point:
        rho2, turn = x * x + (rho0 - y) * (rho0 - y), F.atan2(x, rho0 - y)
        authalic = F.asin((c - rho2 * (cone / SEMI_MAJOR) ** 2) / (cone * pole))
        lat = authalic + _sum([s * F.sin(2.0 * j * authalic) for j, s in enumerate(series, 1)])
        return F.degrees(turn) / cone + ORIGIN[1], F.degrees(lat)

    return to, back


def ways(crs: str) -> tuple[Way, Way]:
    """From longitude and latitude to the system, and back; ValueError if it isn't known."""
    same: Way = lambda x, y: (x, y)
    if crs in ("EPSG:4326", "EPSG:4269"):
        return same, same
    if crs == "EPSG:3857":
        return _mercator()
    if crs == "EPSG:5070":
        return _albers()
    found = re.fullmatch(r"EPSG:(326|327|269)(\d\d)", crs)
    if found and 1 <= int(found[2]) <= 60:
        return _utm(int(found[2]), found[1] == "327")
    raise ValueError(f"no formula for the CRS {crs or 'of a raster that names none'!r}")


def transform(x: Column, y: Column, source: str, target: str) -> Point:
    """Coordinates of one system in another."""
    if source == target:
        return x, y
    back, to = ways(source)[1], ways(target)[0]
    return to(*back(x, y))
