"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres by the spherical law of cosines, with its argument kept within -1 and 1; 0 for equal points."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1) - F.radians(lon2))
    far = RADIUS_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(far)
