"""Raw listings to normalized events, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import zones as Z
from .quarantine import split

_OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2})$"
#: Why a raw row isn't an event, in the order of the checks.
REASONS = ["name", "zone", "start"]


def instant(raw: Column, zone: Column) -> Column:
    """A time text as UTC: by its own offset if it has one, else as wall-clock time of the zone; null if it can't be read."""
    own = F.try_to_timestamp(raw).cast("timestamp_ntz")
    wall = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(raw, _OFFSET, "")), zone).cast("timestamp_ntz")
    return F.when(raw.rlike(_OFFSET), own).otherwise(wall)


def infer_mode(given: Column, join_url: Column, has_place: Column, words: Column) -> Column:
    """virtual, hybrid or inperson: as given, else by link and place, else by what the text says."""
    link = join_url.isNotNull()
    return (
        F.when(given.isNotNull(), given).when(link & ~has_place, "virtual").when(link & has_place, "hybrid")
        .when(~has_place & words.rlike(r"(?i)\b(online|virtual|zoom|webinar|livestream)\b"), "virtual").otherwise("inperson")
    )


def judged(raw: DataFrame, default_zone: str) -> DataFrame:
    """Every row of raw (external_id, name, start, end, tz, all_day, description, location, url, tags) normalized, with the reason if it is refused and the columns as they were `given`.

    reason: a row without a name, with an unknown zone, or without a readable start in the years 1 to 9999; null for an event.  No row's values end
    the job: what can't be read is null.  An all-day event without an end ends a local day later; an end before the start, or one that
    can't be read, is dropped.
    """
    zone = Z.known(F.coalesce("tz", F.lit(default_zone)))
    sane = lambda t: F.when(F.year(t).between(1, 9999), t)
    start, end = sane(instant(F.col("start"), zone)), sane(instant(F.col("end"), zone))
    next_day = F.to_utc_timestamp(sane(F.try_to_timestamp(F.substring("start", 1, 10))) + F.expr("interval 1 day"), zone).cast("timestamp_ntz")
    out = raw.withColumns({"given": F.struct(*raw.columns), "starts_at": start, "end_at": F.when(F.col("all_day") & F.col("end").isNull(), next_day).otherwise(end)})
    reason = F.when(F.coalesce(F.btrim("name"), F.lit("")) == "", "name").when(zone.isNull(), "zone").when(F.col("starts_at").isNull(), "start")
    shared = U.scrub(F.coalesce("description", F.lit("")))
    is_link = F.coalesce(F.col("location").rlike(r"^https?://\S+$"), F.lit(False))
    place = F.when(~is_link, F.col("location"))
    return out.withColumns({
        "reason": reason, "ends_at": F.when(F.col("end_at") >= F.col("starts_at"), F.col("end_at")), "join_url": shared.join_url, "description": T.clean_description(shared.text), "place": place,
        "mode": infer_mode(F.lit(None).cast("string"), shared.join_url, place.isNotNull(), F.concat_ws(" ", "name", "location")),
        "source_url": F.coalesce(U.canonical(F.col("url")), F.when(is_link, U.canonical(F.col("location"))), U.canonical(F.get(U.links(F.col("description")), F.lit(0)))),
        "tags": F.filter(F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.btrim(t)))), lambda t: t != ""),
        "tz_inferred": F.col("tz").isNull() & ~F.coalesce("all_day", F.lit(False)) & ~F.col("start").rlike(_OFFSET),
        "category": T.categorize(F.col("name"), F.col("description"), F.coalesce("tags", F.array().cast("array<string>"))),
    }).drop("end_at")


def normalize(raw: DataFrame, default_zone: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): the rows of judged() without a reason, and those refused as they came, with their reason."""
    return split(judged(raw, default_zone))
