"""Queries of sources, sinks and cards, over payloads that Spark derives from the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import zones as Z
from ..operators import cards as C
from ..operators import directory as D
from ..operators import enrich as E
from ..operators import export as X
from ..sources import api, calendar, delimited, pages, push
from .catalog import query
from .views import LEDGER, NOW, ZONE, ledger, now, table

_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def _payload(spark, d, **fields):
    """Rows with a JSON payload of one page made of each event."""
    return table(spark, d, "events").select(F.to_json(F.struct(*(F.expr(e).alias(n) for n, e in fields.items()))).alias("payload"))


@query(f"""SELECT 'tribe_' || event_id AS external_id, 'Jazz & ' || event_type AS name, {_AT} AS start, '{ZONE}' AS tz, event_id % 2 = 0 AS is_free, CASE WHEN event_id % 3 = 0 THEN 'cancelled' END AS status,
'Lyons' AS locality, 'US' AS country, CASE WHEN event_id % 5 <> 0 THEN CAST(40.5 AS DOUBLE) END AS lat, 'a,' || event_type AS tags FROM events""")
def api_tribe(spark, d):
    rows = _payload(spark, d, events=f"""array(named_struct('id', event_id, 'title', concat(' Jazz &amp; ', event_type), 'start_date', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'timezone', '{ZONE}',
        'cost', if(event_id % 2 = 0, '$0.00', '$5'), 'venue', array(named_struct('city', 'Lyons', 'country', 'United States', 'geo_lat', if(event_id % 5 = 0, '0', '40.5'), 'geo_lng', if(event_id % 5 = 0, '0', '-105.2'))),
        'categories', array(named_struct('name', 'a')), 'tags', array(named_struct('name', event_type)), 'status', if(event_id % 3 = 0, 'draft', 'publish')))""")
    out = api.tribe(rows)
    return out.select("external_id", "name", "start", "tz", "is_free", "status", F.col("locations")[0]["locality"].alias("locality"), F.col("locations")[0]["country"].alias("country"), F.col("locations")[0]["lat"].alias("lat"), F.array_join("tags", ",").alias("tags"))


_MS = "strftime(%s, '%%Y-%%m-%%dT%%H:%%M:%%S.000Z')"


@query(f"""WITH s AS (SELECT *, unnest(CASE WHEN event_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS k, date_trunc('second', ts) AS t FROM events)
SELECT 'mobilize:' || event_id AS external_id, CASE WHEN event_id % 2 = 0 THEN {_MS % 't + to_days(CAST(k AS INTEGER))'} END AS occurrence, {_MS % 't + to_days(CAST(k AS INTEGER))'} AS start, 'phone bank' AS tags,
CASE WHEN event_id % 3 = 0 THEN 'private' END AS privacy, '1 Main, Suite 2' AS street FROM s""")
def api_mobilize(spark, d):
    slot = "named_struct('start_date', cast(cast(ts as timestamp) as long) + %d)"
    rows = _payload(spark, d, data=f"""array(named_struct('id', event_id, 'title', event_type, 'timeslots', if(event_id % 2 = 0, array({slot % 0}, {slot % 86400}), array({slot % 0})), 'event_type', 'PHONE_BANK',
        'visibility', if(event_id % 3 = 0, 'PRIVATE', 'PUBLIC'), 'location', named_struct('address_lines', array('1 Main', '', 'Suite 2'))))""")
    return api.mobilize(rows).select("external_id", "occurrence", "start", F.col("tags")[0].alias("tags"), "privacy", F.col("locations")[0]["street"].alias("street"))


@query(f"""WITH s AS (SELECT *, unnest(CASE WHEN event_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS k, date_trunc('second', ts) AS t FROM events)
SELECT 'localist:' || event_id AS external_id, CASE WHEN event_id % 2 = 0 THEN {_MS % 't + to_days(CAST(k AS INTEGER))'} END AS occurrence, CASE event_id % 3 WHEN 0 THEN 'Hellems' WHEN 1 THEN NULL ELSE 'Old Main' END AS venue,
CASE WHEN event_id % 4 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, 'Talk,Law' AS tags FROM s""")
def api_localist(spark, d):
    slot = "named_struct('event_instance', named_struct('id', event_id, 'start', concat(date_format(ts + make_dt_interval(%d), 'yyyy-MM-dd HH:mm:ss'), '+00:00')))"
    rows = _payload(spark, d, events=f"""array(named_struct('event', named_struct('id', event_id, 'title', event_type, 'address', '1550 Mall, Boulder', 'city', 'Boulder',
        'location_name', case event_id % 3 when 0 then 'Hellems, 1550 Mall, Boulder, CO' when 1 then '1550 Mall' else 'Old Main, Boulder' end, 'status', if(event_id % 4 = 0, 'canceled', 'live'),
        'event_instances', if(event_id % 2 = 0, array({slot % 0}, {slot % 1}), array({slot % 0})), 'filters', named_struct('event_types', array(named_struct('name', 'Talk')), 'departments', array(named_struct('name', 'Law'))))))""")
    return api.localist(rows).select("external_id", "occurrence", F.col("locations")[0]["name"].alias("venue"), "status", F.array_join("tags", ",").alias("tags"))


@query(f"""SELECT 'eventbrite:' || event_id AS external_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN {_AT} || 'Z' ELSE {_AT} END AS start, CASE event_id % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'planned' ELSE 'scheduled' END AS status,
CASE WHEN event_id % 5 = 0 THEN 'virtual' ELSE 'inperson' END AS mode, CASE WHEN event_id % 7 = 0 THEN 'unlisted' END AS privacy FROM events""")
def api_eventbrite(spark, d):
    at = "replace(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', 'T')"
    rows = _payload(spark, d, events=f"""array(named_struct('id', cast(event_id as string), 'name', named_struct('text', event_type), 'start', named_struct('utc', if(event_id % 2 = 0, concat({at}, 'Z'), null), 'local', {at}),
        'status', case event_id % 3 when 0 then 'canceled' when 1 then 'draft' else 'live' end, 'online_event', event_id % 5 = 0, 'listed', event_id % 7 <> 0))""")
    return api.eventbrite(rows).select("external_id", "name", "start", "status", "mode", "privacy")


@query(f"""SELECT CASE WHEN event_id % 2 = 0 THEN 's' || user_id ELSE CAST(event_id AS VARCHAR) END AS external_id, CASE WHEN event_id % 2 = 0 THEN {_MS % "date_trunc('second', ts)"} END AS occurrence,
CASE WHEN event_id % 3 = 0 THEN '(cancelled)' ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 THEN 'cancelled' END AS status, CASE WHEN event_id % 5 = 0 THEN 'Join: https://meet.google.com/x' END AS description FROM events""")
def api_google(spark, d):
    at = "concat(replace(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', 'T'), 'Z')"
    rows = _payload(spark, d, items=f"""array(named_struct('id', cast(event_id as string), 'summary', if(event_id % 3 = 0, null, event_type), 'status', if(event_id % 3 = 0, 'cancelled', 'confirmed'), 'start', named_struct('dateTime', {at}),
        'recurringEventId', if(event_id % 2 = 0, concat('s', user_id), null), 'originalStartTime', named_struct('dateTime', {at}), 'hangoutLink', if(event_id % 5 = 0, 'https://meet.google.com/x', null)))""")
    return api.google(rows).select("external_id", "occurrence", "name", "status", "description")


@query(f"""SELECT 'sq_' || event_id AS external_id, 'new' AS name, {_MS % "date_trunc('second', ts)"} AS start, 'https://c.org/e/' || event_id AS url, 'Boulder' AS locality, 'CO' AS region, '80302' AS postal_code FROM events""")
def api_squarespace(spark, d):
    item = """array(named_struct('id', cast(event_id as string), 'title', '%s', 'startDate', cast(cast(ts as timestamp) as long) * 1000, 'fullUrl', concat('/e/', event_id),
        'location', named_struct('addressLine1', '1 Main', 'addressLine2', 'Boulder, CO 80302')))"""
    rows = _payload(spark, d, website="named_struct('baseUrl', 'https://c.org')", upcoming=item % "new", past=item % "old")
    place = F.col("locations")[0]
    return api.squarespace(rows).select("external_id", "name", "start", "url", place["locality"].alias("locality"), place["region"].alias("region"), place["postal_code"].alias("postal_code"))


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS id, o_orderpriority AS name,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT19:30:00') ELSE strftime(o_orderdate, '%Y-%m-%dT07:00:00') END AS start, o_orderkey % 3 = 0 AS all_day, 'a,b' AS tags
FROM orders WHERE o_orderkey % 11 <> 0""")
def csv_events(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k % 3 == 2, F.concat(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" 7:00 am"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select(F.when(k % 2 == 0, k.cast("string")).alias("UID"), F.col("o_orderpriority").alias("Event Name"), F.when(k % 11 == 0, "soon").otherwise(day).alias("Date"),
                    F.when(k % 3 == 1, "7:30 pm").alias("Start Time"), F.lit("a; b|").alias("Categories"))
    good, _ = delimited.events(rows, delimited.guess(rows.columns), ZONE, F.lit("orders"))
    return good.select(F.when(~F.col("external_id").startswith("csv_"), F.col("external_id")).alias("id"), "name", "start", "all_day", F.array_join("tags", ",").alias("tags"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority || ', "new"' AS name, strftime(o_orderdate, '%Y-%m-%dT19:30:00') AS start, CASE WHEN o_orderkey % 2 = 0 THEN 'Hall ' || o_custkey END AS location, 'Order Status,Total' AS unmapped
FROM orders WHERE o_orderkey % 11 <> 0""")
def csv_file(spark, d):
    """The order book written as a delimited file with headers of its own, and read back by a mapping that is guessed from them."""
    from .streams import scratch

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 11 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    folder = scratch(spark)
    o.select(k.alias("Event ID"), F.concat("o_orderpriority", F.lit(', "new"')).alias("Title"), day.alias("When"), F.lit("7:30 PM").alias("Start time"), F.when(k % 2 == 0, F.concat(F.lit("Hall "), F.col("o_custkey"))).alias("Venue"),
             F.col("o_orderstatus").alias("Order Status"), F.col("o_totalprice").alias("Total")).write.option("header", True).option("escape", '"').csv(folder)
    rows = spark.read.option("header", True).option("escape", '"').csv(folder)
    mapping = delimited.guess(rows.columns)
    good, _ = delimited.events(rows, mapping, ZONE, F.lit("orders"))
    return good.select("external_id", "name", "start", "location", F.lit(",".join(delimited.unmapped(rows.columns, mapping))).alias("unmapped"))


@query(f"""WITH {LEDGER} SELECT id, source, external_id, CASE WHEN id % 4 = 0 THEN 'x' END AS occurrence, state, visibility, 'rule' AS visibility_source, CASE WHEN id % 3 = 0 THEN 'at://x/' || id END AS public_uri, CAST(NULL AS VARCHAR) AS public_cid,
CASE WHEN id % 3 = 1 THEN 'space://x/' || id END AS space_uri, CAST(NULL AS VARCHAR) AS teaser_uri, CASE WHEN id % 5 = 0 THEN '{{"hidden":true}}' END AS override, CASE WHEN id % 7 = 0 THEN 'timeout' END AS last_error, '2024-01-15T12:00:00.000Z' AS first_seen, '2024-01-15T12:00:00.000Z' AS last_seen,
CASE WHEN id % 6 = 0 THEN strftime(starts_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(starts_at) % 1000 AS VARCHAR), 3, '0') || 'Z' END AS missing_since,
CASE WHEN visibility = 'gated' OR id % 2 <> 0 THEN 'Lyons, CO' ELSE 'Hall ' || id % 7 || ', Lyons' END AS place, CASE WHEN state = 'cancelled' THEN 'cancelled' ELSE 'scheduled' END AS status FROM ledger WHERE host = 7 ORDER BY starts_at, id LIMIT 51""")
def owner_rows(spark, d):
    """The first page of a host's ledger, with all that its owner sees of a row."""
    n, text = F.col("id"), lambda v: F.lit(v).cast("string")
    rows = _listing(spark, d).filter("host = 7").withColumns({
        "mode": F.lit("inperson"), "precision": F.when(F.col("exact"), "exact").otherwise("city"), "private": F.lit(False), "gated_fields": F.array().cast("array<string>"), "image": F.when(F.col("has_image"), "i"), "tz_inferred": F.lit(False),
        "occurrence": F.when(n % 4 == 0, "x").otherwise(""), "visibility_source": F.lit("rule"), "public_uri": F.when(n % 3 == 0, F.concat(F.lit("at://x/"), n)), "public_cid": text(None), "space_uri": F.when(n % 3 == 1, F.concat(F.lit("space://x/"), n)),
        "teaser_uri": text(None), "override": F.when(n % 5 == 0, '{"hidden":true}'), "last_error": F.when(n % 7 == 0, "timeout"), "first_seen": now(), "last_seen": now(), "missing_since": F.when(n % 6 == 0, F.col("starts_at")), "status": F.lit("scheduled"),
    })
    shown = C.ledger_view(D.page(rows, 51), ZONE)
    return shown.select(*C.OWNED, *C.OWNED_TIMES, "card.place", "card.status")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS call, event_id AS item, CAST(event_id AS VARCHAR) AS external_id, left(repeat(event_type, 80), 300) AS name, CASE WHEN event_id % 2 = 0 THEN 'cancelled' END AS status,
CASE WHEN event_id % 3 = 0 THEN 'private' END AS privacy FROM events WHERE event_id % 7 <> 0 AND user_id % 9 <> 0""")
def push_events(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("externalId"), F.repeat("event_type", 80).alias("name"), F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("string")).alias("start"),
                              F.when(F.col("event_id") % 2 == 0, "cancelled").otherwise("gone").alias("status"), F.when(F.col("event_id") % 3 == 0, "held").alias("visibility")))
    # Item numbers are per call; every ninth user's calls are too long.
    calls = e.select(F.col("user_id").cast("string").alias("call"), F.when(F.col("user_id") % 9 == 0, 200).otherwise(F.col("event_id") % 100).alias("item"), body.alias("payload"), "event_id")
    good, _ = push.parse(calls, ("event_id",))
    return good.select("call", F.col("event_id").alias("item"), "external_id", "name", "status", "privacy")


@query("""SELECT event_id AS item, CASE WHEN event_id % 3 = 0 THEN 'gated' END AS level, CASE WHEN event_id % 3 = 0 THEN 'crew' END AS audience, 'music' AS category, CASE event_id % 2 WHEN 0 THEN 'Hall' ELSE 'Annex' END AS place, CASE WHEN event_id % 5 = 0 THEN 40.0::DOUBLE END AS lat, 'http://x/' || event_id AS link FROM events""")
def push_asks(spark, d):
    """What pushed items ask for beside their texts."""
    n, e = F.col("event_id"), table(spark, d, "events")
    body = F.to_json(F.struct(
        n.cast("string").alias("externalId"), F.lit("x").alias("name"), F.col("ts").cast("string").alias("start"), F.when(n % 3 == 0, "gated").when(n % 3 == 1, "secret").alias("visibility"), F.lit("crew").alias("audience"), F.lit("music").alias("category"),
        F.when(n % 2 == 0, F.array(F.struct(F.lit("Hall").alias("name")))).alias("locations"), F.lit("Annex").alias("location"), F.when(n % 5 == 0, F.struct(F.lit(40.0).alias("lat"), F.lit(-105.0).alias("lon"))).alias("geo"),
        F.array(F.struct(F.concat(F.lit("http://x/"), n).alias("uri"))).alias("links"),
    ))
    good, _ = push.parse(e.select(n.cast("string").alias("call"), F.lit(0).alias("item"), body.alias("payload"), "event_id"), ("event_id",))
    first = F.get("locations", F.lit(0))
    return good.select(n.alias("item"), "level", "audience", "category", first["name"].alias("place"), first["lat"].alias("lat"), F.get("links", F.lit(0))["uri"].alias("link"))


@query(f"""WITH e AS (SELECT event_id, event_id % 5 AS kind, event_id // 50 AS feed, (date_trunc('second', ts) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS u FROM events)
SELECT feed, count(*) FILTER (kind = 0 OR kind = 1) AS dropped, count(*) FILTER (kind = 0 OR kind = 1) = 0 AS complete, min(CASE WHEN kind > 1 THEN u END) AS window_from FROM e GROUP BY 1""")
def feed_report(spark, d):
    """What each feed of 50 events leaves out: those without a name, and rules that can't be read."""
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.when(k != 0, "SUMMARY:x"), F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), F.date_format("ts", "yyyyMMdd'T'HHmmss")), F.when(k == 1, "RRULE:FREQ=SECONDLY"), F.lit("END:VEVENT"))
    feeds = e.select(F.floor(F.col("event_id") / 50).alias("feed"), block.alias("b")).groupBy("feed").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.collect_list("b"), F.lit("END:VCALENDAR")).alias("body"))
    _, report = calendar.read(feeds, now(), F.lit("2024-04-15 12:00:00").cast("timestamp_ntz"), ZONE)
    return report.select("feed", "dropped", "complete", "window_from")


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title, 'https://x.org/' || page_id AS canonical, 'https://x.org/i' || page_id || '.png' AS image,
CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS calendars, CASE WHEN page_id % 3 = 0 THEN 'luma' ELSE '' END AS platforms FROM pages""")
def page_meta(spark, d):
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<head><link href="https://x.org/'), n, F.lit('" rel="canonical"><meta content="https://x.org/i'), n, F.lit('.png" property="og:image">'),
                    F.when(F.col("page_id") % 2 == 0, '<link rel="alternate" type="text/calendar" href="/all.ics"><a href="/all.ics">c</a>').otherwise(""), F.when(F.col("page_id") % 3 == 0, '<a href="https://lu.ma/x">l</a>').otherwise(""))
    p = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<head>"), head))
    return pages.facts(p).select("page_id", "title", "canonical", "image", F.size("calendar_links").alias("calendars"), F.array_join("platforms", ",").alias("platforms"))


@query("""SELECT page_id, unnest(['/f', '/s']) AS part, url || '#' || unnest(['/f', '/s']) AS external_id, unnest(['Fest ' || page_id, 'Sub']) AS name, unnest(['Free / $12', NULL]) AS price, unnest(['Lyons', NULL]) AS locality,
unnest(['2024-05-01', '2024-05-01T10:00']) AS start FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 'm', NULL, 'Mic ' || page_id, NULL, NULL, '2024-06-01T10:00' FROM pages WHERE page_id % 4 = 0""")
def page_events(spark, d):
    """Linked-data events, and microdata of pages without any."""
    p, n = table(spark, d, "pages"), F.col("page_id").cast("string")
    linked = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Thing","https://schema.org/Festival"],"@id":"'), F.col("url"), F.lit('#/f","name":"Fest '), n,
        F.lit('","startDate":"2024-05-01","offers":[{"price":"0"},{"price":12}],"location":{"@type":"Place","address":{"addressLocality":"Lyons"}},"subEvent":'), F.lit('[{"@type":"Event","@id":"'), F.col("url"),
        F.lit('#/s","name":"Sub","startDate":"2024-05-01T10:00"},{"@type":"Event","@id":"'), F.col("url"), F.lit('#/s","name":"Later","startDate":"2024-05-02T10:00"}]}]}</script>'),
    )
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Event"><h1 itemprop="name">Mic <b>'), n, F.lit('</b></h1><time itemprop="startDate" datetime="2024-06-01T10:00">June</time></div>'))
    p = p.withColumn("html", F.concat("html", F.when(F.col("page_id") % 4 == 0, micro).otherwise(linked)))
    found = pages.linked_events(p)
    both = found.select("page_id", F.substring_index("external_id", "#", -1).alias("part"), "external_id", "name", "price", F.col("locations")[0]["locality"].alias("locality"), "start")
    rest = pages.microdata_events(p, found).select("page_id", F.lit("m").alias("part"), F.lit(None).cast("string").alias("external_id"), "name", "price", F.lit(None).cast("string").alias("locality"), "start")
    return both.unionByName(rest)


def _listing(spark, d):
    n = F.col("id").cast("string")
    return ledger(spark, d).withColumns({
        "uid": n, "fetched_at": now(), "name": F.concat(F.col("category"), F.lit(" night; no, "), n), "all_day": F.col("id") % 10 == 9, "venue": F.concat(F.lit("Hall "), (F.col("id") % 7).cast("string")), "street": F.lit(None).cast("string"),
        "locality": F.lit("Lyons"), "region": F.lit("CO"), "exact": F.col("id") % 2 == 0, "url": F.concat(F.lit("https://x.org/"), n), "description": F.repeat(F.concat(F.col("category"), F.lit("\n")), 20), "status": F.col("state"),
    })


_DAY = f"CAST((%s AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE)"
_BLOCK = f"""WITH {LEDGER}, l AS (SELECT *, {_DAY % 'starts_at'} AS d0, {_DAY % 'coalesce(ends_at, starts_at)'} AS d1, id % 10 = 9 AS allday FROM ledger),
x AS (SELECT id, list_filter(['BEGIN:VEVENT', 'UID:' || id, 'DTSTAMP:20240115T120000Z',
  CASE WHEN allday THEN 'DTSTART;VALUE=DATE:' || strftime(d0, '%Y%m%d') ELSE 'DTSTART:' || strftime(starts_at, '%Y%m%dT%H%M%SZ') END,
  CASE WHEN allday THEN 'DTEND;VALUE=DATE:' || strftime(CASE WHEN d1 > d0 THEN d1 ELSE d0 + 1 END, '%Y%m%d') ELSE 'DTEND:' || strftime(ends_at, '%Y%m%dT%H%M%SZ') END,
  'SUMMARY:' || category || ' night\\; no\\, ' || id, CASE WHEN visibility = 'gated' THEN 'LOCATION:Lyons\\, CO' ELSE 'LOCATION:Hall ' || id % 7 || '\\, Lyons\\, CO' END,
  CASE WHEN visibility <> 'gated' AND id % 2 = 0 THEN 'GEO:' || CAST(lat AS VARCHAR) || ';' || CAST(lon AS VARCHAR) END, 'URL:https://x.org/' || id, 'CATEGORIES:' || category || '\\,' || tags[1] || '\\,' || tags[2],
  'DESCRIPTION:' || repeat(category || '\\n', 20), CASE WHEN state = 'cancelled' THEN 'STATUS:CANCELLED' END, 'END:VEVENT'], lambda s: s IS NOT NULL) AS lines FROM l)
SELECT id, array_to_string(list_transform(lines, lambda s: CASE WHEN length(s) > 74 THEN array_to_string(list_transform(range(0, (length(s) + 72) // 73), lambda k: substr(s, k * 73 + 1, 73)), chr(13) || chr(10) || ' ') ELSE s END), chr(13) || chr(10)) AS block FROM x"""


@query(_BLOCK)
def ics_export(spark, d):
    return _listing(spark, d).select("id", X.event_block(ZONE).alias("block"))


@query(f"""WITH {LEDGER} SELECT CAST(id AS VARCHAR) AS external_id, category || ' night; no, ' || id AS name, CASE WHEN id % 10 = 9 THEN ({_DAY % 'starts_at'}::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' ELSE date_trunc('second', starts_at) END AS starts_at,
id % 10 = 9 AS all_day, CASE WHEN state = 'cancelled' THEN 'cancelled' END AS status, CASE WHEN visibility = 'gated' THEN 'Lyons, CO' ELSE 'Hall ' || id % 7 || ', Lyons, CO' END AS location,
rtrim(repeat(category || chr(10), 20), chr(10)) AS description FROM ledger""")
def ics_events(spark, d):
    """The export written as calendars of at most 200 events, and read back."""
    rows = _listing(spark, d).withColumns({"feed": F.floor(F.col("id") / 200), "rank": F.col("id")})
    found, _ = calendar.read(X.calendars(rows, "feed", ZONE, "tidewheel"), F.lit("1990-01-01").cast("timestamp_ntz"), F.lit("2030-01-01").cast("timestamp_ntz"), ZONE)
    return found.select("external_id", "name", "starts_at", "all_day", "status", "location", "description")


_NTH = "ceil(day(x) / 7.0)"


@query(f"""WITH e AS (SELECT event_id, event_id % 5 AS kind, date_trunc('second', ts) AS wall FROM events), g AS (SELECT event_id, kind, wall, wall::DATE AS d0, unnest(generate_series(wall::DATE::TIMESTAMP, TIMESTAMP '2024-04-16', INTERVAL 1 DAY)) AS x FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY x) AS k FROM g WHERE CASE kind WHEN 0 THEN date_diff('day', d0, x::DATE) % 3 = 0
  WHEN 1 THEN date_diff('day', date_trunc('week', d0), date_trunc('week', x)) % 14 = 0 AND isodow(x) IN (1, 3) WHEN 2 THEN day(x) = day(d0) WHEN 3 THEN isodow(x) = 2 AND {_NTH} = 2 ELSE day(x) = day(last_day(x)) END),
o AS (SELECT event_id, ((x + (wall - wall::DATE)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS starts_at FROM h WHERE k <= 10 AND NOT (kind = 0 AND k = 2))
SELECT CAST(event_id AS VARCHAR) AS external_id, starts_at FROM o WHERE starts_at + INTERVAL 1 HOUR > TIMESTAMP '{NOW}' AND starts_at < TIMESTAMP '2024-04-15 12:00:00'""")
def ics_recurring(spark, d):
    """Each event as a series, by five kinds of rules, over the next 91 days; a feed holds 100 of them."""
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    wall = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    rule = F.when(k == 0, "FREQ=DAILY;INTERVAL=3").when(k == 1, "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE").when(k == 2, "FREQ=MONTHLY").when(k == 3, "FREQ=MONTHLY;BYDAY=2TU").otherwise("FREQ=MONTHLY;BYMONTHDAY=-1")
    zoned = f";TZID={ZONE}:"
    block = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.lit("SUMMARY:Series"), F.concat(F.lit("DTSTART" + zoned), wall("ts")), F.concat(F.lit("RRULE:"), rule, F.lit(";COUNT=10")),
        F.when(k == 0, F.concat(F.lit("EXDATE" + zoned), wall(F.col("ts") + F.expr("interval 3 days")))), F.lit("END:VEVENT"),
    )
    feeds = e.select(F.floor(F.col("event_id") / 100).alias("feed"), block.alias("b")).groupBy("feed").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.collect_list("b"), F.lit("END:VCALENDAR")).alias("body"))
    found, _ = calendar.read(feeds, now(), F.lit("2024-04-15 12:00:00").cast("timestamp_ntz"), ZONE)
    return found.select("external_id", "starts_at")


_L = f"(%s AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}'"
_CLOCK = "CASE WHEN minute(%s) = 0 THEN strftime(%s, '%%-I %%p') ELSE strftime(%s, '%%-I:%%M %%p') END"


@query(f"""WITH {LEDGER}, l AS (SELECT *, {_L % 'starts_at'} AS s, {_L % 'ends_at'} AS e, visibility = 'gated' OR id % 2 <> 0 AS coarse FROM ledger)
SELECT id, CASE WHEN id % 10 = 9 THEN strftime(s, '%a, %b %-d') || ' (all day)' WHEN e IS NULL THEN strftime(s, '%a, %b %-d') || ' · ' || {_CLOCK % ('s', 's', 's')} || ' MST'
 WHEN s::DATE = e::DATE THEN strftime(s, '%a, %b %-d') || ' · ' || {_CLOCK % ('s', 's', 's')} || ' – ' || {_CLOCK % ('e', 'e', 'e')} || ' MST'
 ELSE strftime(s, '%a, %b %-d') || ' ' || {_CLOCK % ('s', 's', 's')} || ' – ' || strftime(e, '%a, %b %-d') || ' ' || {_CLOCK % ('e', 'e', 'e')} || ' MST' END AS "when",
 CASE WHEN coarse THEN 'Lyons, CO' ELSE 'Hall ' || id % 7 || ', Lyons' END AS place, coarse, CASE WHEN NOT coarse THEN lat END AS pin_lat,
 concat_ws(',', CASE WHEN NOT has_image THEN 'image' END, CASE WHEN ends_at IS NULL THEN 'end' END) AS missing, has_image AS complete FROM l""")
def event_cards(spark, d):
    rows = _listing(spark, d).withColumns({
        "mode": F.lit("inperson"), "precision": F.when(F.col("exact"), "exact").otherwise("city"), "private": F.lit(False), "gated_fields": F.array().cast("array<string>"),
        "image": F.when(F.col("has_image"), "i"), "tz_inferred": F.lit(False),
    })
    return C.cards(rows, ZONE).select("id", "when", "place", "coarse", "pin_lat", F.array_join("missing", ",").alias("missing"), "complete")


@query(f"""WITH {LEDGER}, l AS (SELECT *, {_L % 'starts_at'} AS s, visibility = 'gated' OR id % 2 <> 0 AS coarse FROM ledger)
SELECT id, strftime(s, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(s) % 1000 AS VARCHAR), 3, '0') || '-07:00' AS starts_at, visibility = 'public' AS discovery, CASE WHEN coarse THEN 'Lyons' ELSE 'Hall ' || id % 7 END AS place,
CASE WHEN coarse THEN CAST(floor(lat / 0.02) AS BIGINT) || ':' || CAST(floor(lon / 0.02) AS BIGINT) END AS cell, 'true' AS listed FROM l""")
def published_records(spark, d):
    rows = _listing(spark, d).withColumns({
        "mode": F.lit("inperson"), "precision": F.when(F.col("exact"), "exact").otherwise("city"), "private": F.lit(False), "gated_fields": F.array().cast("array<string>"), "postal_code": F.lit("80540"),
        "country": F.lit(None).cast("string"), "platform": F.lit("x"),
    })
    get = F.get_json_object
    return C.records(rows, ZONE).select(
        "id", get("record", "$.startsAt").alias("starts_at"), (get("record", "$.preferences.showInDiscovery") == "true").alias("discovery"), get("record", "$.locations[0].name").alias("place"),
        get("record", "$.locations[1].value").alias("cell"), get("listed", "$.additionalData.listed").alias("listed"))


_SPELT = ["MST", '"Mountain Standard Time"', "/mozilla.org/20050126_1/America/Denver", "(UTC-07:00) Mountain Time (US & Canada)", "america/denver"]


@query("SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE 'America/Denver' END AS zone FROM events")
def zone_names(spark, d):
    n = F.col("event_id") % 6
    spelt = F.element_at(F.array(*map(F.lit, [*_SPELT, "UTC+02:00"])), (n + 1).cast("int"))
    return table(spark, d, "events").select("event_id", Z.resolve(spelt).alias("zone"))


_WEEKDAY = "isodow(x) <= 5"


@query(f"""WITH e AS (SELECT event_id, event_id % 6 AS kind, date_trunc('second', ts) AS wall FROM events), g AS (SELECT event_id, kind, wall, wall::DATE AS d0, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY)) AS x FROM e),
f AS (SELECT *, CASE kind WHEN 3 THEN date_trunc('week', x + INTERVAL 1 DAY) - INTERVAL 1 DAY WHEN 2 THEN date_trunc('year', x) ELSE date_trunc('month', x) END AS p FROM g
  WHERE CASE kind WHEN 0 THEN {_WEEKDAY} WHEN 1 THEN {_WEEKDAY} WHEN 2 THEN month(x) IN (2, 3) AND isodow(x) = 1 WHEN 3 THEN isodow(x) IN (7, 1) AND date_diff('day', date_trunc('week', d0 + INTERVAL 1 DAY), date_trunc('week', x + INTERVAL 1 DAY)) % 14 = 0
    WHEN 4 THEN month(x) IN (2, 4) AND day(x) = day(d0) ELSE isodow(x) = 5 AND ceil(dayofyear(x) / 7.0) = 10 END),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id, p ORDER BY x) AS a, row_number() OVER (PARTITION BY event_id, p ORDER BY x DESC) AS z FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY x) AS k FROM n WHERE x >= d0 AND CASE kind WHEN 0 THEN z = 1 WHEN 1 THEN a = 1 OR z = 2 WHEN 2 THEN z = 1 ELSE true END)
SELECT CAST(event_id AS VARCHAR) AS external_id, ((x + (wall - d0)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS starts_at FROM c WHERE k <= 10 AND ((x + (wall - d0)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' + INTERVAL 1 HOUR > TIMESTAMP '{NOW}' AND ((x + (wall - d0)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' < TIMESTAMP '2024-04-15 12:00:00'""")
def ics_places(spark, d):
    """Series by places within a period, by months, with weeks from Sunday, and by weekdays of the year."""
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    wall = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    weekdays = "BYDAY=MO,TU,WE,TH,FR"
    rule = (
        F.when(k == 0, f"FREQ=MONTHLY;{weekdays};BYSETPOS=-1").when(k == 1, f"FREQ=MONTHLY;{weekdays};BYSETPOS=1,-2").when(k == 2, "FREQ=YEARLY;BYMONTH=2,3;BYDAY=MO;BYSETPOS=-1")
        .when(k == 3, "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,MO").when(k == 4, "FREQ=YEARLY;BYMONTH=2,4").otherwise("FREQ=YEARLY;BYDAY=10FR")
    )
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.lit("SUMMARY:Series"), F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), wall("ts")), F.concat(F.lit("RRULE:"), rule, F.lit(";COUNT=10")), F.lit("END:VEVENT"))
    feeds = e.select(F.floor(F.col("event_id") / 100).alias("feed"), block.alias("b")).groupBy("feed").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.collect_list("b"), F.lit("END:VCALENDAR")).alias("body"))
    found, _ = calendar.read(feeds, now(), F.lit("2024-04-15 12:00:00").cast("timestamp_ntz"), ZONE)
    return found.select("external_id", "starts_at")


_REFUSED = """CASE event_id % 12 WHEN 0 THEN 'name' WHEN 1 THEN 'start' WHEN 2 THEN 'rule' WHEN 3 THEN 'rule' WHEN 4 THEN 'rule' WHEN 5 THEN 'rule' WHEN 6 THEN 'duration' WHEN 7 THEN 'duration' END"""


def _spoilt(spark, d):
    """Feeds of 60 events of which two in three can't be read, each in another way."""
    e, n = table(spark, d, "events"), F.col("event_id") % 12
    broken = (
        F.when(n == 2, "RRULE:FREQ=DAILY;INTERVAL=0").when(n == 3, "RRULE:FREQ=DAILY;COUNT=-1").when(n == 4, "RRULE:FREQ=MONTHLY;BYMONTHDAY=x").when(n == 5, "RRULE:FREQ=DAILY;INTERVAL=-2")
        .when(n == 6, "DURATION:P99999999999999W").when(n == 7, "DURATION:an hour").when(n == 8, "DURATION:PT90M").when(n == 9, "RRULE:FREQ=DAILY;COUNT=1")
    )
    start = F.when(n == 1, "DTSTART:2024-13-45").otherwise(F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), F.date_format("ts", "yyyyMMdd'T'HHmmss")))
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.when(n != 0, "SUMMARY:x"), start, broken, F.lit("END:VEVENT"))
    return e.select(F.floor(F.col("event_id") / 60).alias("feed"), block.alias("b")).groupBy("feed").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.collect_list("b"), F.lit("END:VCALENDAR")).alias("body"))


@query(f"SELECT event_id // 60 AS feed, CAST(event_id AS VARCHAR) AS external_id, {_REFUSED} AS reason FROM events WHERE event_id % 12 < 8")
def ics_refused(spark, d):
    """Blocks that are set aside, with their reasons; the others of their feeds stay (ics_kept)."""
    return calendar.judged(_spoilt(spark, d), ZONE).filter("reason is not null").select("feed", "external_id", "reason")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS external_id, (date_trunc('second', ts) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS starts_at,
CASE WHEN event_id % 12 = 8 THEN ((date_trunc('second', ts) + INTERVAL 90 MINUTE) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' END AS ends_at FROM events WHERE event_id % 12 >= 8""")
def ics_kept(spark, d):
    found, _ = calendar.read(_spoilt(spark, d), F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2030-01-01").cast("timestamp_ntz"), ZONE)
    return found.select("external_id", "starts_at", "ends_at")


_SERIES = f"""e AS (SELECT event_id, event_id % 6 AS kind, date_trunc('second', ts) AS wall, date_trunc('second', ts)::DATE AS d0 FROM events),
g AS (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-16', INTERVAL 1 DAY)) AS x FROM e WHERE kind <> 5),
h AS (SELECT event_id, kind, wall, x, (week(x) IN (4, 9) AND isoyear(x) = year(x) AND isodow(x) = 3) AS wk, (dayofyear(x) IN (40, 100) OR dayofyear(x) = 366 - 300) AS yd FROM g),
o AS (SELECT event_id, x + (wall - wall::DATE) AS w FROM h WHERE (kind = 0 AND wk) OR (kind = 1 AND yd)
  UNION ALL SELECT event_id, x + to_hours(CAST(v AS INTEGER)) + to_minutes(CAST(minute(wall) AS INTEGER)) + to_seconds(second(wall)) FROM (SELECT *, unnest([9, 17]) AS v FROM g WHERE kind = 2 AND date_diff('day', d0, x::DATE) % 2 = 0)
  UNION ALL SELECT event_id, x + to_hours(CAST(v AS INTEGER)) + to_minutes(CAST(minute(wall) AS INTEGER)) + to_seconds(second(wall)) FROM (SELECT *, unnest([8, 20]) AS v FROM g WHERE kind = 3 AND isodow(x) = 1)
  UNION ALL SELECT event_id, x + to_hours(6) + to_minutes(CAST(v AS INTEGER)) + to_seconds(second(wall)) FROM (SELECT *, unnest([0, 30]) AS v FROM g WHERE kind = 4 AND day(x) = 1)
  UNION ALL SELECT event_id, unnest(generate_series(date_trunc('hour', wall), TIMESTAMP '2024-04-16', INTERVAL 7 HOUR)) + (wall - date_trunc('hour', wall)) FROM e WHERE kind = 5),
c AS (SELECT event_id, w, row_number() OVER (PARTITION BY event_id ORDER BY w) AS k FROM o JOIN e USING (event_id) WHERE w >= wall),
u AS (SELECT event_id, k, (w AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS starts_at FROM c)"""


@query(f"""WITH {_SERIES} SELECT CAST(event_id AS VARCHAR) AS external_id, starts_at FROM u WHERE k <= 60 AND starts_at + INTERVAL 1 HOUR > TIMESTAMP '{NOW}' AND starts_at < TIMESTAMP '2024-04-15 12:00:00'""")
def ics_numbered(spark, d):
    """Series by week and day numbers of the year, by hours and minutes of a day, and by the hour."""
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    rule = (
        F.when(k == 0, "FREQ=YEARLY;BYWEEKNO=4,9;BYDAY=WE").when(k == 1, "FREQ=YEARLY;BYYEARDAY=40,100,-301").when(k == 2, "FREQ=DAILY;INTERVAL=2;BYHOUR=9,17").when(k == 3, "FREQ=WEEKLY;BYDAY=MO;BYHOUR=20,8")
        .when(k == 4, "FREQ=MONTHLY;BYMONTHDAY=1;BYHOUR=6;BYMINUTE=0,30").otherwise("FREQ=HOURLY;INTERVAL=7")
    )
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.lit("SUMMARY:Series"), F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), F.date_format("ts", "yyyyMMdd'T'HHmmss")), F.concat(F.lit("RRULE:"), rule, F.lit(";COUNT=60")), F.lit("END:VEVENT"))
    feeds = e.select(F.floor(F.col("event_id") / 100).alias("feed"), block.alias("b")).groupBy("feed").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.collect_list("b"), F.lit("END:VCALENDAR")).alias("body"))
    found, _ = calendar.read(feeds, now(), F.lit("2024-04-15 12:00:00").cast("timestamp_ntz"), ZONE)
    return found.select("external_id", "starts_at")


@query(f"""WITH e AS (SELECT event_id, event_id % 3 AS kind, date_trunc('second', ts) AS t, {_L % "date_trunc('second', ts)"} AS wall FROM events), g AS (SELECT *, unnest(generate_series(wall::DATE::TIMESTAMP, TIMESTAMP '2024-04-16', INTERVAL 1 DAY)) AS x FROM e WHERE kind < 2),
h AS (SELECT event_id, ((x + (wall - wall::DATE)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS u FROM g WHERE kind = 0 OR isodow(x) = isodow(wall)), k AS (SELECT event_id, u, row_number() OVER (PARTITION BY event_id ORDER BY u) AS nth FROM h WHERE u <= TIMESTAMP '{NOW}' + INTERVAL 90 DAY)
SELECT CAST(event_id AS VARCHAR) AS external_id, u AS starts_at, u + INTERVAL 2 HOUR AS ends_at, CAST(event_id AS VARCHAR) AS series_key FROM k WHERE nth <= 60 UNION ALL SELECT CAST(event_id AS VARCHAR), t, t + INTERVAL 2 HOUR, NULL FROM e WHERE kind = 2""")
def confirmed_series(spark, d):
    k, at = F.col("event_id") % 3, F.date_trunc("second", "ts").cast("timestamp_ntz")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("external_id"), at.alias("starts_at"), (at + F.expr("interval 2 hours")).alias("ends_at"), F.lit(ZONE).alias("zone"), F.when(k == 0, "RRULE:FREQ=DAILY").when(k == 1, "FREQ=WEEKLY").alias("rule"))
    return calendar.confirmed(rows, now()).select("external_id", "starts_at", "ends_at", "series_key")


@query(f"""WITH {LEDGER}, s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY starts_at, id) AS nth FROM ledger WHERE state IN ('live', 'cancelled') AND visibility IN ('public', 'gated') AND starts_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}' + INTERVAL 10 DAY)
SELECT host, count(*) AS events, min(CASE WHEN nth = 1 THEN id END) AS first_id FROM s WHERE nth <= 5 GROUP BY 1""")
def host_calendars(spark, d):
    """Calendars of hosts with their next events, as counts of what each body holds."""
    body = X.calendars(X.select(_listing(spark, d), "host", now(), 10, 5), "host", ZONE, "tidewheel")
    return body.select("host", F.size(F.regexp_extract_all("body", F.lit("BEGIN:VEVENT"), F.lit(0))).cast("long").alias("events"), F.regexp_extract("body", r"UID:(\d+)", 1).cast("long").alias("first_id"))


@query("""WITH p AS (SELECT page_id, page_id % 3 = 0 AS reused, CASE page_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'logo.png' END AS a, CASE WHEN page_id % 4 = 1 THEN 'data' END AS b, CASE WHEN page_id % 7 = 2 THEN 'cover' END AS c FROM pages)
SELECT page_id, coalesce(CASE WHEN a <> 'logo.png' THEN a END, b, c, CASE WHEN NOT reused THEN 'og' END) AS image FROM p""")
def picked_image(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select(
        "page_id", F.when(n % 5 == 0, "native").when(n % 5 == 1, "logo.png").alias("native_image"), F.when(n % 4 == 1, "data").alias("data_image"), F.when(n % 7 == 2, "cover").alias("cover_image"), F.lit("og").alias("preview_image"), (n % 3 == 0).alias("is_default"),
    )
    return E.pick_image(rows).select("page_id", "image")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_orders(spark, d):
    return E.first_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
