"""Great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_RADIUS, M_RADIUS = 6371.0088, 6371000.0


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)


def _angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Half the angle between two points; null if a coordinate is."""
    h = _haversine(lat1, lon1, lat2, lon2)
    return F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * KM_RADIUS * _angle(lat1, lon1, lat2, lon2)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * M_RADIUS * _angle(lat1, lon1, lat2, lon2)


def coordinate(value: Column, limit: float) -> Column:
    """Whether a coordinate is present, finite and within the limit."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) <= limit), F.lit(False))
