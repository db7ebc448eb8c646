"""Distances between points given as longitude and latitude in degrees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean earth radius and metres in a mile (as the queries use it); WGS84 axis and flattening.
RADIUS, MILE = 6_371_008.8, 1609.34
AXIS, FLAT = 6_378_137.0, 1 / 298.257223563


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees in the plane, as nearest-neighbour orders on geometries use them."""
    return F.sqrt(F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2))


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def within(lon: Column, lat: Column, lon0: float, lat0: float, metres: float) -> Column:
    """Points at most so far from a given one; a box test on the plain columns comes first and can be pushed down."""
    high = metres / 110_000
    wide = 180.0 if abs(lat0) + high >= 89 else high / float(np.cos(np.radians(min(89, abs(lat0) + high))))
    west, east = lon0 - wide, lon0 + wide
    box = lat.between(lat0 - high, lat0 + high)
    if west >= -180 and east <= 180:
        box = box & lon.between(west, east)
    return box & (haversine(lon, lat, F.lit(lon0), F.lit(lat0)) <= metres)


def vincenty_metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Metres on the WGS84 spheroid; nan for nearly opposite points, where the iteration doesn't settle."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    minor = AXIS * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2))
    apart = lon2 - lon1
    lam = apart.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            alpha = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / s, 0)
            square = 1 - alpha**2
            middle = np.where(square > 0, c - 2 * np.sin(u1) * np.sin(u2) / square, 0)
            k = FLAT / 16 * square * (4 + FLAT * (4 - 3 * square))
            new = apart + (1 - k) * FLAT * alpha * (sigma + k * s * (middle + k * c * (2 * middle**2 - 1)))
            moved, lam = np.abs(new - lam), new
            if not (moved > 1e-12).any():
                break
        u = square * (AXIS**2 - minor**2) / minor**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = b * s * (middle + b / 4 * (c * (2 * middle**2 - 1) - b / 6 * middle * (4 * s**2 - 3) * (4 * middle**2 - 3)))
        return np.where(s > 0, np.where(moved > 1e-9, np.nan, minor * a * (sigma - delta)), 0.0)


@F.pandas_udf(T.DoubleType())
def spheroid(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_metres(lon1, lat1, lon2, lat2))


def within_spheroid(rows: DataFrame, lon: Column, lat: Column, lon0: float, lat0: float, metres: float) -> DataFrame:
    """Rows at most so far from a point on the spheroid, with the distance as `metres`.

    Box and sphere come first: the sphere's distance is off by less than 0.6 %, so only what lies near enough by
    that much goes to Python.
    """
    near = rows.where(within(lon, lat, lon0, lat0, metres * 1.006))
    return near.withColumn("metres", spheroid(lon, lat, F.lit(float(lon0)), F.lit(float(lat0)))).where(F.col("metres") <= metres)
