"""What a viewer is shown of an event: time label, place label, pin, missing parts, and the published record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zones as Z
from ..functions.places import coarse_cell

# What stands for a place that isn't shown, and the types of a published record.
HIDDEN_PLACE = "Location shared with confirmed guests"
RECORD = "community.lexicon.calendar.event"
ADDRESS, GEO, CELL = "community.lexicon.location.address", "community.lexicon.location.geo", "community.lexicon.location.hthree"


def when_label(start: Column, zone: Column, end: Column, all_day: Column) -> Column:
    """Day, time and zone of an event as its guests read it; start and end are UTC."""
    local = lambda c: F.from_utc_timestamp(c.cast("timestamp"), zone)
    s, e = local(start), local(end)
    day = lambda c: F.date_format(c, "EEE, MMM d")
    clock = lambda c: F.when(F.minute(c) == 0, F.date_format(c, "h a")).otherwise(F.date_format(c, "h:mm a"))
    short = Z.short_name(start, zone)
    spans = F.coalesce(F.timestamp_diff("SECOND", s, e) > 86400, F.lit(False))
    text = F.concat(day(s), F.lit(" · "), clock(s))
    return (
        F.when(all_day & spans, F.concat(day(s), F.lit(" – "), day(e - F.expr("interval 1 day")), F.lit(" (all day)"))).when(all_day, F.concat(day(s), F.lit(" (all day)")))
        .when(end.isNull(), F.concat(text, F.lit(" "), short)).when(F.to_date(s) == F.to_date(e), F.concat(text, F.lit(" – "), clock(e), F.lit(" "), short))
        .otherwise(F.concat(day(s), F.lit(" "), clock(s), F.lit(" – "), day(e), F.lit(" "), clock(e), F.lit(" "), short))
    )


def is_coarse() -> Column:
    """Whether only the town may be shown: gated events, private or inexact places, and places kept back."""
    kept_back = F.coalesce(F.array_contains("gated_fields", "exactLocation"), F.lit(False))
    return F.coalesce(F.col("visibility") == "gated", F.lit(False)) | F.coalesce("private", F.lit(False)) | (F.coalesce("precision", F.lit("")) != "exact") | kept_back


def cards(events: DataFrame, zone: str) -> DataFrame:
    """Cards of events (id, starts_at, ends_at, all_day, visibility, mode, venue, street, locality, region, lat, lon,
    precision, private, gated_fields, image, tz_inferred, description)."""
    filled = lambda *names: F.array_join(F.array_distinct(F.filter(F.array(*names), lambda p: p != "")), ", ")
    some = F.coalesce("venue", "street", "locality", "region", F.col("lat").cast("string")).isNotNull()
    coarse = some & is_coarse()
    town, full = filled("locality", "region"), filled("venue", "street", "locality")
    label = F.when(~some, F.when(F.col("mode") == "virtual", "Online")).when(coarse, F.when(town != "", town).otherwise(HIDDEN_PLACE)).otherwise(F.when(full != "", full))
    out = events.withColumns({"place": label, "coarse": coarse, "when": when_label(F.col("starts_at"), F.lit(zone), F.col("ends_at"), F.coalesce("all_day", F.lit(False)))})
    missing = F.array_compact(F.array(
        F.when(F.col("image").isNull(), "image"), F.when(F.col("place").isNull() & (F.col("mode") != "virtual"), "place"), F.when(F.col("tz_inferred"), "timezone"),
        F.when(F.col("description").isNull(), "description"), F.when(F.col("ends_at").isNull(), "end"),
    ))
    pin = lambda c: F.when(some & ~F.col("coarse"), F.col(c)).alias(f"pin_{c}")
    return out.select("id", "when", "place", "coarse", pin("lat"), pin("lon"), missing.alias("missing"), (~F.arrays_overlap(missing, F.array(F.lit("image"), F.lit("place"), F.lit("timezone")))).alias("complete"))


#: Columns of a ledger row that its owner sees as they are, and those shown as ISO texts in UTC.
OWNED, OWNED_TIMES = ["id", "source", "external_id", "occurrence", "state", "visibility", "visibility_source", "public_uri", "public_cid", "space_uri", "teaser_uri", "override", "last_error"], ["first_seen", "last_seen", "missing_since"]


def ledger_view(rows: DataFrame, zone: str) -> DataFrame:
    """Ledger rows as their owner sees them: OWNED and OWNED_TIMES, and the card with the row's own state; an empty occurrence is none.

    rows: the columns of cards() and of OWNED and OWNED_TIMES; status is the listing's, which a cancelled row overrules.
    """
    card = cards(rows, zone)
    both = rows.join(card.select(F.col("id").alias("of"), F.struct(*(c for c in card.columns if c != "id")).alias("card")), F.col("id") == F.col("of"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    status = F.when(F.col("state") == "cancelled", "cancelled").otherwise(F.col("status"))
    named = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c) if c == "occurrence" else F.col(c)
    return both.select(*map(named, OWNED), F.col("card").withField("status", status).alias("card"), *map(iso, OWNED_TIMES))


def published_places(country: str = "US") -> Column:
    """array of address, point and cell structs of the row's place; a coarse one gives town and grid cell only."""
    empty = lambda *keep: {n: F.lit(None).cast("string") for n in keep}
    names = ["name", "street", "locality", "region", "postalCode", "country", "latitude", "longitude", "value"]
    make = lambda kind, **v: F.struct(F.lit(kind).alias("$type"), *((empty(n) | v)[n].alias(n) for n in names))
    home, both = F.coalesce("country", F.lit(country)), F.col("lat").isNotNull() & F.col("lon").isNotNull()
    c = F.col
    town = F.when(F.coalesce("locality", "region").isNotNull(), make(ADDRESS, name=c("locality"), locality=c("locality"), region=c("region"), country=home))
    cell = F.when(both, make(CELL, name=F.coalesce("locality", "venue"), value=coarse_cell(c("lat"), c("lon"))))
    full = F.when(F.coalesce("venue", "street", "locality", "region", "postal_code").isNotNull(), make(ADDRESS, name=c("venue"), street=c("street"), locality=c("locality"), region=c("region"), postalCode=c("postal_code"), country=home))
    point = F.when(both, make(GEO, name=c("venue"), latitude=c("lat").cast("string"), longitude=c("lon").cast("string")))
    return F.array_compact(F.when(is_coarse(), F.array(town, cell)).otherwise(F.array(full, point)))


def local_iso(at: Column, zone: str) -> Column:
    """Local time with its offset."""
    wall = F.from_utc_timestamp(at.cast("timestamp"), zone)
    minutes = F.timestamp_diff("MINUTE", at, wall.cast("timestamp_ntz"))
    offset = F.when(minutes == 0, "Z").otherwise(F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset)


def records(events: DataFrame, zone: str) -> DataFrame:
    """(id, record, listed): the JSON to publish, and the one that only tells that an event is listed."""
    c = F.col
    common = [
        F.lit(RECORD).alias("$type"), c("name"), local_iso(c("starts_at"), zone).alias("startsAt"), local_iso(c("ends_at"), zone).alias("endsAt"), F.lit(zone).alias("timezone"),
        F.concat(F.lit(RECORD + "#"), c("mode")).alias("mode"), F.concat(F.lit(RECORD + "#"), c("status")).alias("status"), F.struct((c("visibility") == "public").alias("showInDiscovery")).alias("preferences"),
    ]
    uris = F.array(F.struct(c("url").alias("uri"), c("platform").alias("name")))
    source = F.struct(c("url"), c("external_id").alias("id"))
    whole = F.struct(*common, c("description"), published_places().alias("locations"), uris.alias("uris"), F.struct(source.alias("externalSource"), c("category"), c("tags")).alias("additionalData"))
    listed = F.struct(*common, uris.alias("uris"), F.struct(source.alias("externalSource"), F.lit(True).alias("listed")).alias("additionalData"))
    return events.select("id", F.to_json(whole).alias("record"), F.to_json(listed).alias("listed"))


def invalid_records(published: DataFrame) -> DataFrame:
    """(id, reason) of records that lack a time zone, a start, or the address and id of their source."""
    get = lambda path: F.get_json_object("record", path)
    need = {"timezone": "$.timezone", "startsAt": "$.startsAt", "source url": "$.additionalData.externalSource.url", "source id": "$.additionalData.externalSource.id"}
    gone = F.array_compact(F.array(*(F.when(get(p).isNull(), n) for n, p in need.items())))
    return published.select("id", F.array_join(gone, ", ").alias("reason")).filter("reason <> ''")
