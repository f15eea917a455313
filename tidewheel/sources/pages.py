"""Web pages to events and page facts, by column functions on the page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raw import blank, place, raw

DEPTH = 7
# Event types, the keys that hold further nodes, and what gives a platform away.
EVENT_TYPES = [
    "Event", "MusicEvent", "SocialEvent", "BusinessEvent", "ChildrensEvent", "ComedyEvent", "CourseInstance", "DanceEvent", "DeliveryEvent", "EducationEvent", "ExhibitionEvent",
    "Festival", "FoodEvent", "Hackathon", "LiteraryEvent", "PublicationEvent", "SaleEvent", "ScreeningEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent",
]
INNER = ["@graph", "itemListElement", "item", "mainEntity", "hasPart", "event", "events"]
PLATFORMS = [
    ("tribe", r'(?i)tribe-events|/wp-json/tribe/|tribe_events|class="[^"]*tribe-'), ("wordpress", r'(?i)wp-content/|wp-includes/|<meta name="generator" content="WordPress'),
    ("squarespace", r'(?i)static1\.squarespace\.com|<meta name="generator" content="Squarespace|squarespace-cdn'), ("localist", r"(?i)localist(?:\.com|-)"), ("tockify", r"(?i)tockify\.com"),
    ("libcal", r"libcal\.com|LibCal"), ("civicplus", r"(?i)civicplus|CivicEngage"), ("trumba", r"(?i)trumba\.com"), ("teamup", r"(?i)teamup\.com"), ("eventbrite", r"(?i)eventbrite\.(?:com|co\.uk|ca)"),
    ("humanitix", r"(?i)humanitix\.com"), ("dandelion", r"(?i)dandelion\.events"), ("partiful", r"(?i)partiful\.com"), ("facebook", r"(?i)facebook\.com/events"), ("luma", r"(?i)lu\.ma|luma\.com|lumacdn"), ("meetup", r"(?i)meetup\.com"),
]
CALENDAR_HREF = r"(?i)\.ics(\?|$)|^webcal:|/ical/?(\?|$)|format=ical"


def _get(html: Column, pattern: str, group: int = 1) -> Column:
    return blank(F.regexp_extract(html, pattern, group))


def meta(html: Column, *names: str) -> Column:
    """Content of the first meta tag of the first name that has one."""
    return F.coalesce(*(_get(html, rf"""(?is)<meta\b(?=[^>]*\b(?:name|property)=["']{n}["'])[^>]*?\bcontent=["']([^"']*)["']""") for n in names))


def absolute(link: Column, base: Column) -> Column:
    """A link against the address of its page; null for null."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.when(base.rlike(r"^https?://[^/?#]+/"), F.regexp_extract(base, r"^(https?://[^/?#]+/(?:[^?#]*/)?)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link.rlike("^[?#]"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link)).otherwise(F.concat(folder, link))
    )


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, title, canonical, image, og_title, description, generator, calendar_links, platforms) of pages (page_id, url, html)."""
    h, base = F.col("html"), F.col("url")
    tags = F.regexp_extract_all(h, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    href = lambda t: F.regexp_extract(t, r"""(?is)\bhref=["']([^"']*)["']""", 1)
    typed = F.transform(F.filter(tags, lambda t: t.rlike("""(?i)\\btype=["']text/calendar["']""")), href)
    anchors = F.filter(F.regexp_extract_all(h, F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1)), lambda u: u.rlike(CALENDAR_HREF))
    every = F.array_distinct(F.transform(F.concat(typed, F.transform(anchors, lambda u: F.regexp_replace(u, "(?i)^webcal:", "https:"))), lambda u: absolute(u, base)))
    canonical = F.get(F.transform(F.filter(tags, lambda t: t.rlike("""(?i)\\brel=["']canonical["']""")), href), F.lit(0))
    return pages.select(
        "page_id", _get(h, r"(?is)<title\b[^>]*>(.*?)</title>").alias("title"), absolute(canonical, base).alias("canonical"), absolute(meta(h, "og:image", "twitter:image"), base).alias("image"),
        meta(h, "og:title").alias("og_title"), meta(h, "description", "og:description").alias("description"), meta(h, "generator").alias("generator"),
        F.coalesce(every, F.array().cast("array<string>")).alias("calendar_links"), F.array_compact(F.array(*(F.when(h.rlike(p), n) for n, p in PLATFORMS))).alias("platforms"),
    )


def _path(key: str) -> str:
    return f'$["{key}"]'


def _many(v: Column, key: str | None = None) -> Column:
    """array<variant> of what a key holds: an array's items, or the one value."""
    path = _path(key) if key else "$"
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _str(v: Column, *keys: str) -> Column:
    """Text of the first key: a text or number, the first of an array, or an object's @value, name or url."""
    def one(x: Column) -> Column:
        inner = [F.try_variant_get(x, _path(k), "string") for k in ("@value", "name", "url", "contentUrl")]
        plain = F.try_variant_get(x, "$", "string")
        return blank(F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(*inner)).otherwise(plain))
    return F.coalesce(*(F.get(F.transform(_many(v, k), one), F.lit(0)) for k in keys))


def _types(v: Column) -> Column:
    named = F.when(F.try_variant_get(v, _path("@type"), "variant").isNotNull(), _many(v, "@type")).otherwise(_many(v, "type"))
    return F.transform(named, lambda t: F.regexp_replace(F.coalesce(F.try_variant_get(t, "$", "string"), F.lit("")), "^.*[/#]", ""))


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, url, at, node) for each event node of the linked-data blocks, down to DEPTH; `at` sorts as they come."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<script\b[^>]*\btype=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("i", "block")).select("page_id", "url", F.lpad("i", 6, "0").alias("at"), F.try_parse_json("block").alias("node"), F.lit(False).alias("done"))
    n = F.col("node")
    step = lambda v, done: F.struct(v.alias("node"), F.lit(done).alias("done"))
    for _ in range(DEPTH):
        is_list = F.schema_of_variant(n).startswith("ARRAY")
        event = F.arrays_overlap(_types(n), F.array(*map(F.lit, EVENT_TYPES)))
        onward = F.when(is_list, _many(n)).otherwise(F.concat(*(_many(n, k) for k in INNER)))
        parts = (
            F.when(F.col("done"), F.array(step(n, True)))
            .when(~is_list & event, F.concat(F.array(step(n, True)), F.transform(_many(n, "subEvent"), lambda v: step(v, False))))
            .otherwise(F.transform(onward, lambda v: step(v, False)))
        )
        rows = rows.filter(n.isNotNull()).select("page_id", "url", "at", F.posexplode(parts).alias("i", "x")).select(
            "page_id", "url", F.concat_ws(".", "at", F.lpad("i", 6, "0")).alias("at"), "x.node", "x.done")
    return rows.filter("done").drop("done")


def linked_events(pages: DataFrame) -> DataFrame:
    """Raw rows of the event nodes; of equal ids on a page the first counts."""
    v, real, address, geo = (F.col(c) for c in ("node", "real", "address", "geo"))
    none = F.lit(None).cast("variant")
    first = lambda c, k: F.get(_many(c, k), F.lit(0))
    # Parts are put in columns of their own first, so that each is worked out once.
    rows = nodes(pages).withColumn("places", F.transform(_many(v, "location"), lambda x: F.struct(x.alias("v"), F.array_contains(_types(x), "VirtualLocation").alias("virtual"), F.schema_of_variant(x).alias("kind"))))
    pick = lambda test: F.coalesce(F.get(F.filter("places", test), F.lit(0))["v"], none)
    rows = rows.withColumns({
        "virtual": pick(lambda x: x["virtual"]), "real": pick(lambda x: ~x["virtual"] & x["kind"].startswith("OBJECT")), "words": pick(lambda x: x["kind"] == "STRING"),
        "name": _str(v, "name"), "start": _str(v, "startDate"), "link": absolute(_str(v, "url"), F.col("url")),
        "prices": F.filter(F.transform(_many(v, "offers"), lambda o: F.coalesce(F.try_variant_get(o, _path("price"), "string"), F.try_variant_get(o, _path("lowPrice"), "string"))), lambda p: p != ""),
        "keywords": F.flatten(F.transform(_many(v, "keywords"), lambda k: F.split(F.try_variant_get(k, "$", "string"), ","))),
        "given": F.regexp_replace(_str(v, "eventStatus"), "^.*[/#]", ""), "attended": F.regexp_replace(_str(v, "eventAttendanceMode"), "^.*[/#]", ""),
    }).withColumns({"address": first(real, "address"), "geo": first(real, "geo")})
    rows = rows.withColumns({
        "street": F.when(F.schema_of_variant(address) == "STRING", F.try_variant_get(address, "$", "string")).otherwise(_str(address, "streetAddress")),
        "town": _str(address, "addressLocality"), "state": _str(address, "addressRegion"), "zip": _str(address, "postalCode"), "country": _str(address, "addressCountry"),
        "prices": F.array_distinct(F.transform("prices", lambda p: F.when(p.try_cast("double") == 0, "Free").when(p.rlike(r"^\d"), F.concat(F.lit("$"), p)).otherwise(p))),
        "tags": F.filter(F.transform("keywords", lambda t: F.btrim(t)), lambda t: t != ""), "place_name": _str(real, "name"), "lat": _str(geo, "latitude"), "lon": _str(geo, "longitude"),
        "key": F.coalesce(_str(v, "@id"), _str(v, "identifier"), "link", F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("|", "name", "start"), 256), 1, 24))),
    })
    c, priced = F.col, F.size("prices") > 0
    out = raw(
        rows, ("page_id", "at"), external_id=c("key"), name=c("name"), start=c("start"), end=_str(v, "endDate"), all_day=c("start").rlike(r"^\d{4}-\d\d-\d\d$"), description=_str(v, "description"),
        url=F.coalesce("link", "url"), image=absolute(_str(v, "image"), c("url")), organizer=_str(v, "organizer"),
        status=F.when(c("given") == "EventCancelled", "cancelled").when(c("given") == "EventPostponed", "postponed").when(c("given") == "EventRescheduled", "rescheduled"),
        mode=F.when(c("attended") == "OnlineEventAttendanceMode", "virtual").when(c("attended") == "MixedEventAttendanceMode", "hybrid").when(c("attended") == "OfflineEventAttendanceMode", "inperson"),
        location=F.coalesce(_str(c("virtual"), "url"), F.try_variant_get("words", "$", "string")),
        locations=place(name=c("place_name"), street=c("street"), locality=c("town"), region=c("state"), postal_code=c("zip"), country=c("country"), lat=c("lat"), lon=c("lon")),
        price=F.when(priced, F.array_join("prices", " / ")), is_free=F.when(priced, F.forall("prices", lambda p: p == "Free")), tags=F.when(F.size("tags") > 0, c("tags")),
    )
    rest = [n for n in out.columns if n not in ("page_id", "external_id", "at")]
    return out.groupBy("page_id", "external_id").agg(F.min_by(F.struct(*rest), "at").alias("r")).select("page_id", "external_id", "r.*")


def microdata_events(pages: DataFrame, linked: DataFrame) -> DataFrame:
    """Raw rows of itemscope events, of the pages on which `linked` has none."""
    bare = pages.join(linked.select("page_id").distinct(), "page_id", "left_anti")
    types = "|".join(EVENT_TYPES)
    scopes = F.split("html", r"(?i)(?=<[a-z0-9]+\b[^>]*\bitemscope\b[^>]*\bitemtype=)")
    mine = F.filter(scopes, lambda s: s.rlike(rf"""(?i)^<[a-z0-9]+\b[^>]*\bitemtype=["']https?://schema\.org/(?:{types})["']"""))
    rows = bare.select("page_id", "url", F.explode(mine).alias("s"))

    def prop(n: str) -> Column:
        tag = rf"""(?is)<([a-z0-9]+)\b[^>]*\bitemprop=["']{n}["'][^>]*>"""
        head = F.regexp_extract("s", tag, 0)
        held = F.coalesce(*(_get(head, rf"""(?is)\b{a}=["']([^"']*)["']""") for a in ("content", "datetime", "href", "src")))
        return F.coalesce(held, blank(F.regexp_replace(F.regexp_extract("s", tag + r"(.*?)</\1>", 2), "<[^>]*>", "")))

    name, start, link = prop("name"), prop("startDate"), absolute(prop("url"), F.col("url"))
    key = F.coalesce(link, F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("|", name, start), 256), 1, 24)))
    return raw(rows, ("page_id",), external_id=key, name=name, start=start, end=prop("endDate"), all_day=start.rlike(r"^\d{4}-\d\d-\d\d$"), description=prop("description"),
               url=F.coalesce(link, F.col("url")), image=absolute(prop("image"), F.col("url")), location=prop("location")).dropDuplicates(["page_id", "external_id"])
