"""Great-circle distance on built-in trig functions (R22: acos input clamped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.labels import EARTH_RADIUS_KM


def great_circle_km(lat1, lng1, lat2, lng2) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    la1, ln1, la2, ln2 = (F.radians(c(x).cast("double")) for x in (lat1, lng1, lat2, lng2))
    x = F.cos(la1) * F.cos(la2) * F.cos(ln2 - ln1) + F.sin(la1) * F.sin(la2)
    clamped = F.when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)
    return F.lit(EARTH_RADIUS_KM) * F.acos(clamped)
