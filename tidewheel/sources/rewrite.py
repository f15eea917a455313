"""Feeds of two calendar services: the address that guests know, and no picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the services spell their addresses and ids.
SHORT = r"(?i)https?://(?:lu\.ma|luma\.com)/([a-z0-9]{6,12})\b"
LUMA_HOST, LUMA_LONG, LUMA_UID = r"(?i)(?:lu\.ma|luma\.com)/", r"(?i)^https?://(?:www\.)?luma\.com/", r"^(evt-[A-Za-z0-9]+)@"
MEETUP_UID = r"(?i)^event_([A-Za-z0-9]+)@meetup\.com$"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def luma(rows: DataFrame) -> DataFrame:
    """url: the first short address in the description, else the given one on the short host, else one made from the id."""
    slug, home = _found(F.col("description"), SHORT), F.lit("https://lu.ma/")
    told = F.when(~slug.startswith("event"), F.concat(home, slug))
    given = F.when(F.col("url").rlike(LUMA_HOST), F.regexp_replace("url", LUMA_LONG, "https://lu.ma/"))
    made = F.concat(home, _found(F.col("external_id"), LUMA_UID))
    return rows.withColumns({"url": F.coalesce(told, given, made, "url"), "image": F.lit(None).cast("string")})


def meetup(rows: DataFrame, group: Column) -> DataFrame:
    """url: as given, else the group's page of the event that the id names."""
    made = F.concat(F.lit("https://www.meetup.com/"), group, F.lit("/events/"), _found(F.col("external_id"), MEETUP_UID), F.lit("/"))
    return rows.withColumns({"url": F.coalesce(F.nullif("url", F.lit("")), made), "image": F.lit(None).cast("string")})
