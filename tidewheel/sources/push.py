"""Pushed events: checks of each payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raw import FIELDS, blank, coalesced, raw

SCHEMA = """externalId string, name string, start string, end string, tz string, allDay boolean, description string, descriptionIsHtml boolean, url string, imageUrl string, location string,
 organizerName string, status string, mode string, priceText string, isFree boolean, tags array<string>, visibility string, audience string, gatedFields array<string>, category string, geo struct<lat:double,lon:double>,
 locations array<struct<name:string,street:string,locality:string,region:string,postalCode:string,country:string,lat:double,lon:double>>, links array<struct<uri:string,name:string>>, _corrupt string"""
# Longest texts, most tags, most items of a call, and the words that status and mode may be.
LONGEST = {"external_id": 200, "name": 300, "description": 20000, "location": 500, "price": 100, "organizer": 200}
TAGS, ITEMS = 20, 200
STATUSES = ["scheduled", "cancelled", "postponed", "rescheduled", "planned"]
MODES = ["inperson", "virtual", "hybrid"]
LEVELS = ["public", "unlisted", "gated", "members", "invite", "held"]


def parse(calls: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(raw rows, refused items) of calls (call, item, payload): item counts from 0 within a call.

    A call of more than ITEMS items is refused whole, which a count over the calls tells; an item is refused if it isn't
    JSON or lacks an id, a name or a start.  Texts are cut to their longest, and unknown words of status and mode become null.  Beside the raw
    columns an item keeps what it asks for: level (one that is known) with audience and gated_fields, category, and links.
    """
    sizes = calls.groupBy("call").agg(F.max("item").alias("last"))
    rows = calls.join(sizes, "call").withColumn("p", F.from_json("payload", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    p = lambda n: F.col(f"p.{n}")
    cut = lambda c, n: F.substring(c, 1, LONGEST[n])
    good = (F.col("last") < ITEMS) & p("_corrupt").isNull() & (p("externalId") != "") & blank(p("name")).isNotNull() & p("start").isNotNull()
    good = F.coalesce(good, F.lit(False))
    level = F.when(p("visibility").isin(*LEVELS), p("visibility"))
    places = F.transform(p("locations"), lambda l: F.struct(*(l["postalCode" if n == "postal_code" else n].cast(t).alias(n) for n, t in FIELDS)))
    where = coalesced(places, p("location"), p("geo.lat"), p("geo.lon"))
    extra = {"level": level, "audience": F.when(level.isNotNull(), p("audience")), "gated_fields": F.when(level.isNotNull(), p("gatedFields")), "category": p("category"), "links": p("links")}
    out = raw(
        rows.filter(good).withColumns(extra), ("call", "item", *keep, *extra), external_id=cut(p("externalId"), "external_id"), name=cut(blank(p("name")), "name"), start=p("start"), end=p("end"), tz=p("tz"),
        all_day=F.coalesce(p("allDay"), F.lit(False)), description=cut(p("description"), "description"), description_is_html=F.coalesce(p("descriptionIsHtml"), F.lit(False)), url=p("url"), image=p("imageUrl"),
        location=cut(p("location"), "location"), locations=where, organizer=cut(p("organizerName"), "organizer"), status=F.when(p("status").isin(*STATUSES), p("status")), mode=F.when(p("mode").isin(*MODES), p("mode")),
        price=cut(p("priceText"), "price"), is_free=p("isFree"), tags=F.slice("p.tags", 1, TAGS), privacy=F.when(p("visibility") == "held", "private"),
    )
    why = F.when(F.col("last") >= ITEMS, "too many").when(p("_corrupt").isNotNull(), "not json").otherwise("missing field")
    return out, rows.filter(~good).select("call", "item", why.alias("reason"))
