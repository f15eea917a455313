"""JSON payloads of event services to raw rows: one scan, schema in hand, no shuffle but where ids repeat.

Each function takes rows with a `payload` column (one page of one service) and keeps the columns it is told to.  A payload
that isn't JSON of the service gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raw import blank, place, raw

TRIBE = """events array<struct<id long, title string, description string, url string, website string, start_date string, end_date string, timezone string, all_day boolean, cost string,
 modified string, image struct<url string>, venue array<struct<venue string, address string, city string, state string, province string, zip string, country string, geo_lat string, geo_lng string>>,
 organizer array<struct<organizer string>>, categories array<struct<name string>>, tags array<struct<name string>>, status string>>"""
_ITEMS = """array<struct<id string, urlId string, title string, body string, excerpt string, startDate long, endDate long, fullUrl string, assetUrl string,
 location struct<addressTitle string, addressLine1 string, addressLine2 string, addressCountry string, mapLat double, mapLng double>, categories array<string>, tags array<string>>>"""
SQUARESPACE = f"website struct<baseUrl string, timeZone string>, upcoming {_ITEMS}, items {_ITEMS}, past {_ITEMS}"
LOCALIST = """events array<struct<event struct<id long, title string, description string, description_text string, localist_url string, url string, photo_url string, location_name string, address string,
 city string, state string, zip string, geo struct<latitude string, longitude string>, free boolean, cost string, experience string, status string, private boolean, updated_at string,
 event_instances array<struct<event_instance struct<id long, start string, end string, all_day boolean>>>, filters struct<event_types array<struct<name string>>, departments array<struct<name string>>>>>>"""
MOBILIZE = """data array<struct<id long, title string, description string, timezone string, is_virtual boolean, visibility string, browser_url string, featured_image_url string, event_type string,
 modified_date long, sponsor struct<name string>, timeslots array<struct<id long, start_date long, end_date long>>,
 location struct<venue string, address_lines array<string>, locality string, region string, postal_code string, location struct<latitude double, longitude double>>>>"""
EVENTBRITE = """events array<struct<id string, name struct<text string>, description struct<html string, text string>, summary string, url string, start struct<timezone string, local string, utc string>,
 end struct<local string, utc string>, status string, online_event boolean, listed boolean, is_free boolean, changed string, series_id string, logo struct<url string, original struct<url string>>,
 venue struct<name string, address struct<address_1 string, address_2 string, city string, region string, postal_code string, country string, latitude string, longitude string>>,
 organizer struct<name string>, category struct<name string>, subcategory struct<name string>>>"""
_WHEN = "struct<date string, dateTime string, timeZone string>"
GOOGLE = f"""timeZone string, items array<struct<id string, summary string, description string, status string, start {_WHEN}, end {_WHEN}, originalStartTime {_WHEN}, recurringEventId string, hangoutLink string,
 location string, htmlLink string, organizer struct<displayName string>, visibility string, updated string, attachments array<struct<mimeType string, fileUrl string>>>>"""
# The entities that feeds leave in titles.
ENTITIES = [("&#8217;", "’"), ("&#8211;", "–"), ("&#038;", "&"), ("&amp;", "&"), ("&#8220;", '"'), ("&#8221;", '"'), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]
SECOND_LINE = r"^\s*([^,]+?)\s*,\s*([A-Za-z .]+?)\s*(\d{5}(?:-\d{4})?)?\s*$"


def plain(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return blank(text)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _names(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda t: t["name"]), F.array().cast("array<string>"))


def _filled(tags: Column) -> Column:
    out = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(out) > 0, out)


def _each(pages: DataFrame, schema: str, field: str, keep: tuple[str, ...]) -> DataFrame:
    return pages.select(*keep, F.from_json("payload", schema).alias("p")).select(*keep, "p", F.explode(f"p.{field}").alias("e"))


def _country(c: Column, us: str) -> Column:
    return F.when(c.rlike(us), "US").otherwise(c)


def tribe(pages: DataFrame, zone: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    e, v = (lambda n: F.col(f"e.{n}")), F.get("e.venue", F.lit(0))
    cost = blank(e("cost"))
    return raw(
        _each(pages, TRIBE, "events", keep), keep, external_id=F.concat(F.lit("tribe_"), e("id").cast("string")), name=plain(e("title")), start=F.replace(e("start_date"), F.lit(" "), F.lit("T")),
        end=F.replace(e("end_date"), F.lit(" "), F.lit("T")), tz=F.coalesce(e("timezone"), F.lit(zone)), all_day=e("all_day"), description=e("description"), description_is_html=e("description").isNotNull(),
        url=F.coalesce(e("url"), e("website")), image=e("image.url"), organizer=plain(F.get("e.organizer", F.lit(0))["organizer"]), price=plain(cost), is_free=cost.rlike(r"(?i)^(free|\$?0(\.00)?)$"),
        locations=place(name=plain(v["venue"]), street=v["address"], locality=v["city"], region=F.coalesce(v["state"], v["province"]), postal_code=v["zip"], country=_country(v["country"], "(?i)united states"), lat=v["geo_lat"], lon=v["geo_lng"]),
        tags=_filled(F.transform(F.concat(_names(e("categories")), _names(e("tags"))), plain)), status=F.when(e("status") != "publish", "cancelled"), last_modified=e("modified"),
    )


def squarespace(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of upcoming, items and past; within a page the first of each id counts."""
    parts = [F.col(f"p.{n}") for n in ("upcoming", "items", "past")]
    whole = F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))
    ids = F.transform("all", lambda i: F.coalesce(i["id"], i["urlId"], i["startDate"].cast("string")))
    rows = pages.select(*keep, F.from_json("payload", SQUARESPACE).alias("p")).withColumn("all", whole).withColumn("ids", ids)
    first = F.filter(F.sequence(F.lit(1), F.size("all")), lambda k: F.array_position("ids", F.element_at("ids", k)) == k)
    rows = rows.filter(F.size("all") > 0).select(*keep, "p", F.explode(F.transform(first, lambda k: F.struct(F.element_at("ids", k).alias("key"), F.element_at("all", k).alias("i")))).alias("x")).select(*keep, "p", "x.key", F.col("x.i").alias("e"))
    e, at = (lambda n: F.col(f"e.{n}")), (lambda n: iso(F.timestamp_millis(F.col(f"e.{n}"))))
    line2 = e("location.addressLine2")
    cut = lambda i: F.when(line2.rlike(SECOND_LINE), F.regexp_extract(line2, SECOND_LINE, i))
    body = F.coalesce(blank(e("body")), blank(e("excerpt")))
    link = F.when(e("fullUrl").rlike("^https?://"), e("fullUrl")).otherwise(F.concat(F.regexp_replace("p.website.baseUrl", "/+$", ""), F.when(e("fullUrl").startswith("/"), "").otherwise("/"), e("fullUrl")))
    return raw(
        rows, keep, external_id=F.concat(F.lit("sq_"), F.col("key")), name=blank(e("title")), start=at("startDate"), end=at("endDate"), tz=F.col("p.website.timeZone"), description=body,
        description_is_html=body.isNotNull(), url=link, image=e("assetUrl"), tags=_filled(F.concat(F.coalesce(e("categories"), F.array().cast("array<string>")), F.coalesce(e("tags"), F.array().cast("array<string>")))),
        locations=F.when(F.coalesce(blank(e("location.addressTitle")), blank(e("location.addressLine1"))).isNotNull() | (e("location.mapLat") != 0) | (e("location.mapLng") != 0), place(
            name=e("location.addressTitle"), street=e("location.addressLine1"), locality=F.coalesce(cut(1), line2), region=cut(2), postal_code=cut(3),
            country=_country(e("location.addressCountry"), "(?i)united states|^usa?$"), lat=e("location.mapLat"), lon=e("location.mapLng"))),
    )


def localist(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each instance; an occurrence and a series only where an event has several."""
    rows = _each(pages, LOCALIST, "events", keep).withColumn("e", F.col("e.event"))
    slots = F.filter(F.transform("e.event_instances", lambda i: i["event_instance"]), lambda i: i["start"].isNotNull())
    rows = rows.withColumn("slots", slots).withColumn("i", F.explode("slots"))
    e = lambda n: F.col(f"e.{n}")
    key, many = F.concat(F.lit("localist:"), e("id").cast("string")), F.size("slots") > 1
    name, street = blank(e("location_name")), blank(e("address"))
    at = F.position(F.lower(F.substring_index(street, ",", 1)), F.lower(name))
    cut = F.when(at > 1, F.regexp_replace(F.substring(name, F.lit(1), at - 1), r"[,\s]+$", "")).when(at == 1, None).otherwise(name)
    tail = F.concat(F.lit(", "), F.lower(e("city")))
    cut = F.when(F.lower(cut).endswith(tail), F.substring(cut, F.lit(1), F.length(cut) - F.length(tail))).otherwise(cut)
    return raw(
        rows, keep, external_id=key, occurrence=F.when(many, iso(F.try_to_timestamp("i.start"))), name=blank(e("title")), start=F.col("i.start"), end=F.col("i.end"), all_day=F.coalesce("i.all_day", F.lit(False)),
        description=F.coalesce(e("description"), e("description_text")), description_is_html=e("description").isNotNull(), url=F.coalesce(e("localist_url"), e("url")), image=e("photo_url"),
        mode=F.when(e("experience").isin("virtual", "hybrid"), e("experience")).otherwise("inperson"), is_free=e("free"), price=F.when(e("free"), "Free").otherwise(e("cost")),
        locations=F.when(F.coalesce(name, street).isNotNull(), place(name=cut, street=street, locality=e("city"), region=e("state"), postal_code=e("zip"), lat=e("geo.latitude"), lon=e("geo.longitude"))),
        tags=_filled(F.concat(_names(e("filters.event_types")), _names(e("filters.departments")))), status=F.when(e("status") == "canceled", "cancelled").otherwise("scheduled"),
        privacy=F.when(e("private"), "private"), series_key=F.when(many, key), last_modified=e("updated_at"),
    )


def mobilize(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each timeslot; an occurrence and a series only where an event has several."""
    rows = _each(pages, MOBILIZE, "data", keep).withColumn("slots", F.filter("e.timeslots", lambda t: t["start_date"].isNotNull())).withColumn("t", F.explode("slots"))
    e, at = (lambda n: F.col(f"e.{n}")), (lambda c: iso(F.timestamp_seconds(F.col(c))))
    key, many = F.concat(F.lit("mobilize:"), e("id").cast("string")), F.size("slots") > 1
    lines = F.filter(e("location.address_lines"), lambda s: s != "")
    return raw(
        rows, keep, external_id=key, occurrence=F.when(many, at("t.start_date")), name=blank(e("title")), start=at("t.start_date"), end=at("t.end_date"), tz=e("timezone"), description=e("description"),
        mode=F.when(e("is_virtual"), "virtual").otherwise("inperson"), url=e("browser_url"), image=e("featured_image_url"), organizer=e("sponsor.name"),
        locations=F.when(blank(e("location.venue")).isNotNull() | (F.size(lines) > 0), place(name=e("location.venue"), street=F.array_join(lines, ", "), locality=e("location.locality"), region=e("location.region"),
            postal_code=e("location.postal_code"), lat=e("location.location.latitude"), lon=e("location.location.longitude"))),
        tags=F.when(e("event_type").isNotNull(), F.array(F.replace(F.lower(e("event_type")), F.lit("_"), F.lit(" ")))), series_key=F.when(many, key),
        privacy=F.when(e("visibility") == "PRIVATE", "private"), last_modified=at("e.modified_date"),
    )


def eventbrite(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    e, a = (lambda n: F.col(f"e.{n}")), (lambda n: F.col(f"e.venue.address.{n}"))
    return raw(
        _each(pages, EVENTBRITE, "events", keep), keep, external_id=F.concat(F.lit("eventbrite:"), e("id")), name=blank(e("name.text")), start=F.coalesce(e("start.utc"), e("start.local")),
        end=F.coalesce(e("end.utc"), e("end.local")), tz=e("start.timezone"), description=F.coalesce(e("description.html"), e("description.text"), e("summary")), description_is_html=e("description.html").isNotNull(),
        status=F.when(e("status") == "canceled", "cancelled").when(e("status") == "draft", "planned").otherwise("scheduled"), mode=F.when(e("online_event"), "virtual").otherwise("inperson"),
        locations=place(name=e("venue.name"), street=F.concat_ws(", ", blank(a("address_1")), blank(a("address_2"))), locality=a("city"), region=a("region"), postal_code=a("postal_code"), country=a("country"), lat=a("latitude"), lon=a("longitude")),
        url=e("url"), image=F.coalesce(e("logo.original.url"), e("logo.url")), organizer=e("organizer.name"), is_free=e("is_free"), price=F.when(e("is_free"), "Free"),
        tags=_filled(F.array(e("category.name"), e("subcategory.name"))), series_key=e("series_id"), privacy=F.when(~e("listed"), "unlisted"), last_modified=e("changed"),
    )


def google(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calendar items; cancelled ones stay as tombstones, a moved occurrence keeps its original start."""
    e = lambda n: F.col(f"e.{n}")
    tz, gone = F.coalesce(e("start.timeZone"), F.col("p.timeZone")), e("status") == "cancelled"
    was = F.coalesce(e("originalStartTime.dateTime"), e("originalStartTime.date"))
    own = was.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    at = F.when(own, F.try_to_timestamp(was)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(was), F.coalesce(e("originalStartTime.timeZone"), tz, F.lit("UTC"))))
    body = F.concat_ws("\n\n", blank(e("description")), F.when(e("hangoutLink").isNotNull(), F.concat(F.lit("Join: "), e("hangoutLink"))))
    shown, picture = F.lower(e("visibility")), F.get(F.filter(e("attachments"), lambda a: a["mimeType"].startswith("image/") & a["fileUrl"].isNotNull()), F.lit(0))
    return raw(
        _each(pages, GOOGLE, "items", keep), keep, external_id=F.coalesce(e("recurringEventId"), e("id")), occurrence=F.when(e("recurringEventId").isNotNull(), iso(at)),
        name=F.coalesce(e("summary"), F.when(gone, "(cancelled)")), start=F.coalesce(e("start.dateTime"), e("start.date")), end=F.coalesce(e("end.dateTime"), e("end.date")), tz=tz, all_day=e("start.date").isNotNull(),
        description=blank(body), description_is_html=F.coalesce(e("description").rlike(r"(?i)<(p|br|a|div|ul|ol|li|b|i|strong|em|span)\b"), F.lit(False)), location=e("location"), url=e("htmlLink"),
        organizer=e("organizer.displayName"), status=F.when(gone, "cancelled"), series_key=e("recurringEventId"), image=picture["fileUrl"],
        privacy=F.when(shown.isin("private", "confidential", "public"), shown), last_modified=e("updated"),
    )
