"""The one shape that every source gives: raw event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<name:string,street:string,locality:string,region:string,postal_code:string,country:string,lat:double,lon:double>"
FIELDS = [f.split(":") for f in LOCATION[len("struct<"):-1].split(",")]
RAW = {
    "external_id": "string", "occurrence": "string", "name": "string", "start": "string", "end": "string", "tz": "string", "all_day": "boolean",
    "description": "string", "description_is_html": "boolean", "url": "string", "image": "string", "organizer": "string", "locations": f"array<{LOCATION}>",
    "location": "string", "mode": "string", "status": "string", "price": "string", "is_free": "boolean", "tags": "array<string>", "series_key": "string",
    "privacy": "string", "last_modified": "string",
}


def place(**parts: Column) -> Column:
    """array of one location, or null if every part is null; (0, 0) is no point."""
    kept = dict(parts)
    if "lat" in kept:
        lat, lon = kept["lat"].try_cast("double"), kept["lon"].try_cast("double")
        real = (lat != 0) | (lon != 0)
        kept |= {"lat": F.when(real, lat), "lon": F.when(real, lon)}
    for name in ("name", "street", "locality", "region", "postal_code", "country"):
        if name in kept:
            kept[name] = blank(kept[name])
    one = F.struct(*(kept.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS))
    return F.when(F.coalesce(*(c.cast("string") for c in kept.values())).isNotNull(), F.array(one))


def coalesced(locations: Column, text: Column, lat: Column, lon: Column) -> Column:
    """Places of a listing: those given, else its text as a name, else a point alone; a point goes to a first place without one."""
    given = F.when(F.size(locations) > 0, locations)
    first = F.get(F.coalesce(given, place(name=text), F.array(F.lit(None).cast(LOCATION))), F.lit(0))
    bare = F.coalesce(first.lat, first.lon).isNull()
    both = lat.isNotNull() & lon.isNotNull()
    filled = F.when(bare & both, F.coalesce(first, F.struct(*(F.lit(None).cast(t).alias(n) for n, t in FIELDS))).withField("lat", lat).withField("lon", lon)).otherwise(first)
    rest = F.when(F.size(locations) > 1, F.slice(locations, 2, F.size(locations))).otherwise(F.array().cast(f"array<{LOCATION}>"))
    return F.when(filled.isNotNull(), F.concat(F.array(filled), rest))


def blank(c: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.when(F.btrim(c) != "", F.btrim(c))


def raw(rows: DataFrame, keep: tuple[str, ...] = (), **given: Column) -> DataFrame:
    """Rows of RAW after the columns to keep; fields not given are null, and rows without id, name or start go."""
    out = rows.select(*keep, *((given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in RAW.items()))
    return out.filter(F.col("external_id").isNotNull() & F.col("name").isNotNull() & F.col("start").isNotNull())
