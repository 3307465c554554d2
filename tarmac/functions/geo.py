"""Great-circle distance and coordinate checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.fields import EARTH_RADIUS_MILES


def distance_miles(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Haversine distance in whole miles, rounded half to even."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_long = F.sin(F.radians(long2 - long1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_long * half_long
    angle = F.atan2(F.sqrt(chord), F.sqrt(1 - chord)) * 2
    return F.bround(angle * EARTH_RADIUS_MILES, 0).cast("int")


def coordinate_status(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """200 for usable coordinates, 500 when one is missing, 400 when one is out of range.

    NaN sorts above every number, so the range test rejects it too.
    """
    missing = lat1.isNull() | long1.isNull() | lat2.isNull() | long2.isNull()
    in_range = (
        lat1.between(-90, 90) & lat2.between(-90, 90)
        & long1.between(-180, 180) & long2.between(-180, 180)
    )
    return F.when(missing, 500).when(~in_range, 400).otherwise(200)
