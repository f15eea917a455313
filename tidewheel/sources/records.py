"""Published records of other repositories, read back as raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .push import MODES, STATUSES
from .raw import blank, place, raw

SCHEMA = """name string, startsAt string, endsAt string, timezone string, description string, mode string, status string, createdAt string, uris array<struct<uri string, name string>>,
 locations array<struct<`$type` string, name string, street string, locality string, region string, postalCode string, country string, latitude string, longitude string, value string>>,
 media array<struct<role string, content struct<ref struct<`$link` string>>>>, preferences struct<showInDiscovery boolean>,
 additionalData struct<externalSource string, tags array<string>, allDay boolean, organizerName string, priceText string, isFree boolean>"""


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _places(locations: Column) -> Column:
    """One location: the last address, a name from the other entries if it has none, and the last point."""
    ends = lambda x, *kinds: F.coalesce(x["$type"].rlike(r"location\.(" + "|".join(kinds) + ")$"), F.lit(False))
    number = lambda x, n: x[n].try_cast("double")
    home = _last(F.filter(locations, lambda x: ends(x, "address")))
    point = _last(F.filter(locations, lambda x: ends(x, "geo") & number(x, "latitude").isNotNull() & number(x, "longitude").isNotNull()))
    others = F.filter(locations, lambda x: ~ends(x, "address"))
    words = F.array_compact(F.transform(others, lambda x: F.coalesce(blank(x["name"]), F.when(~ends(x, "geo", "hthree", "fsq"), blank(x["value"])))))
    return place(
        name=F.coalesce(blank(home["name"]), F.get(words, F.lit(0))), street=home["street"], locality=home["locality"], region=home["region"], postal_code=home["postalCode"], country=home["country"],
        lat=point["latitude"], lon=point["longitude"],
    )


def read(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw rows of records (uri, did, host, record): record is JSON, host is where pictures of the repository are.

    Mirrors of events from elsewhere, which name their external source, are left out, so that a directory doesn't read
    what it wrote.  A record that isn't JSON or lacks a name or a start gives no row.
    """
    r = lambda n: F.col(f"r.{n}")
    more = lambda n: F.col(f"r.additionalData.{n}")
    own = rows.withColumn("r", F.from_json("record", SCHEMA)).filter(F.coalesce(more("externalSource"), F.lit("")).isin("", "false", "0"))
    word = lambda n, known: F.when(F.lower(F.substring_index(r(n), "#", -1)).isin(*known), F.lower(F.substring_index(r(n), "#", -1)))
    thumb = F.coalesce(F.get(F.filter(r("media"), lambda m: m["role"] == "thumbnail"), F.lit(0)), F.get(r("media"), F.lit(0)))
    link = F.nullif(thumb["content"]["ref"]["$link"], F.lit(""))
    picture = F.concat("host", F.lit("/xrpc/com.atproto.sync.getBlob?did="), F.url_encode("did"), F.lit("&cid="), F.url_encode(link))
    uris = F.filter(F.transform(r("uris"), lambda u: blank(u["uri"])), lambda u: u.rlike("^https?://"))
    tags = F.array_compact(F.transform(more("tags"), blank))
    return raw(
        own, keep, external_id=F.substring_index("uri", "/", -1), name=blank(r("name")), start=blank(r("startsAt")), end=blank(r("endsAt")), tz=blank(r("timezone")), all_day=F.coalesce(more("allDay"), F.lit(False)),
        description=blank(r("description")), description_is_html=F.lit(False), url=F.get(uris, F.lit(0)), image=picture, organizer=blank(more("organizerName")), locations=_places(r("locations")),
        mode=word("mode", MODES), status=word("status", STATUSES), price=blank(more("priceText")), is_free=more("isFree"), tags=tags, privacy=F.when(~r("preferences.showInDiscovery"), "unlisted"),
        last_modified=blank(r("createdAt")),
    )
