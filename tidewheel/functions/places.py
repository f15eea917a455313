"""Column functions on coordinates and local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = (39.5, 40.4, -105.8, -104.8)
EARTH_KM = 6371.0


def in_box(lat: Column, lon: Column, box=BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    p = lambda x: F.radians(x)
    a = F.pow(F.sin((p(lat) - p(F.lit(lat0))) / 2), 2) + F.cos(p(lat)) * F.cos(p(F.lit(lat0))) * F.pow(F.sin((p(lon) - p(F.lit(lon0))) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def near(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """Within km, after a box that a scan can prune by."""
    d_lat, d_lon = km / 110.0, km / (110.0 * 0.7)
    return lat.between(lat0 - d_lat, lat0 + d_lat) & lon.between(lon0 - d_lon, lon0 + d_lon) & (distance_km(lat, lon, lat0, lon0) <= km)


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def wall_to_utc(wall: Column, zone: Column | str) -> Column:
    """The instant of a wall-clock time in a zone, as a time without zone in UTC."""
    return F.to_utc_timestamp(wall.cast("timestamp"), zone).cast("timestamp_ntz")


def coarse_cell(lat: Column, lon: Column, degrees: float = 0.02) -> Column:
    """Id of a grid cell of about five square kilometres."""
    return F.concat_ws(":", F.floor(lat / degrees), F.floor(lon / degrees))
