"""Column expressions for places and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def intensity_band(km: Column, magnitude: Column) -> Column:
    """A warning band from distance and magnitude. The attenuation is this library's own choice: I = 1.5 M - 3.5 log10(R + 10) + 3."""
    i = 1.5 * magnitude - 3.5 * F.log10(km + 10) + 3
    return F.when(i >= 7, "severe").when(i >= 5, "strong").when(i >= 3, "light").otherwise("none")


def warning(name: Column, km: Column, band: Column, seconds: Column) -> Column:
    """A personal message: who, how strong, how far, and the seconds until the shear wave."""
    advice = F.when(band == "severe", "take cover now").when(band == "strong", "take cover").when(band == "light", "stay alert").otherwise("no action needed")
    return F.format_string("%s: %s shaking, %.0f km away, %.0f s left, %s", name, band, km, seconds, advice)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
