"""Queries of search, venues and places, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import directory as D
from ..operators import enrich as N
from ..operators import search as S
from . import views as V
from .catalog import GUARD, T0, query
from .views import LEDGER, ZONE, ledger, now, table


def _index_sql(parts: str) -> str:
    """CTEs of an inverted index x (id, attribute, position, token) over SELECTs of (id, attribute, text)."""
    return f"""i AS (SELECT id, attribute, string_split_regex(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM ({parts})),
x AS (SELECT * FROM (SELECT id, attribute, unnest(range(len(w))) AS position, unnest(w) AS token FROM i) WHERE token <> '' AND NOT list_contains({S.STOPS}, token))"""


def _hits_sql(words: str, typos: bool = False) -> str:
    """CTEs of hits (id, n_terms, typos, spread, best_attribute, n_exact) in x."""
    rows = ", ".join(f"({n}, {p.first}, {p.last}, {j}, {len(p.tokens)}, '{t}', {int(p.exact)}, {S.allowed_typos(t)})" for n, p in enumerate(S.phrases(words)) for j, t in enumerate(p.tokens))
    asked = f"(VALUES {rows}) v(phrase, a, z, off, size, word, exact, most)"
    near = f"SELECT v.*, token, levenshtein(token, word) AS typos FROM {asked} JOIN (SELECT DISTINCT token FROM x) ON levenshtein(token, word) <= most"
    return f"""q AS ({near if typos else f"SELECT *, word AS token, 0 AS typos FROM {asked}"}),
pl AS (SELECT id, attribute, phrase, a, z, size, exact, position - off AS start, off, min(typos) AS typos FROM x JOIN q USING (token) GROUP BY ALL),
h AS (SELECT id, attribute, a, z, exact, start, sum(typos) AS typos FROM pl GROUP BY id, attribute, phrase, a, z, size, exact, start HAVING count(*) = any_value(size)),
tm AS (SELECT id, attribute, exact, start, typos, unnest(range(a, z + 1)) AS term FROM h),
bt AS (SELECT id, term, min(typos) AS typos, min(attribute) AS attribute, max(CASE WHEN typos = 0 THEN exact ELSE 0 END) AS exact FROM tm GROUP BY ALL),
wh AS (SELECT id, count(*) AS n_terms, sum(typos) AS typos, min(attribute) AS best_attribute, sum(exact) AS n_exact FROM bt GROUP BY 1),
wd AS (SELECT id, attribute, count(*) AS n, max(start) - min(start) AS spread FROM (SELECT id, attribute, term, min(start) AS start FROM tm GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT id, n_terms, CAST(typos AS BIGINT) AS typos, CAST(spread AS INTEGER) AS spread, CAST(best_attribute AS INTEGER) AS best_attribute, CAST(n_exact AS BIGINT) AS n_exact
  FROM wh JOIN (SELECT id, arg_max(spread, (n, -attribute)) AS spread FROM wd GROUP BY 1) USING (id))"""


_ORDER = "n_terms DESC, typos, spread, best_attribute, n_exact DESC"
_PARTS = _index_sql("SELECT p_partkey AS id, 0 AS attribute, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part")


def _part_hits(spark, d, words, **how):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return S.search(S.index(part, ["p_name", "p_type"]), words, **how)


@query(f"WITH {_PARTS}, {_hits_sql('small ring economy')} SELECT * FROM hits ORDER BY {_ORDER}, id LIMIT 200")
def search_rank(spark, d):
    return S.ranked(_part_hits(spark, d, "small ring economy"), 200)


_TEXTS = _index_sql("SELECT doc_id AS id, 0 AS attribute, source AS text FROM documents UNION ALL SELECT doc_id, 1, text FROM documents")


@query(f"WITH {_TEXTS}, {_hits_sql('FUR été, Straße web')} SELECT * FROM hits ORDER BY {_ORDER}, id LIMIT 200")
def search_accents(spark, d):
    """Texts of several languages, found whatever their accents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return S.ranked(S.search(S.index(docs, ["source", "text"]), "FUR été, Straße web"), 200)


@query(f"WITH {_PARTS} SELECT token, count(*) AS n FROM (SELECT * FROM x WHERE id % 5 <> 0 UNION ALL SELECT * FROM ({_index_sql("SELECT p_partkey AS id, 0 AS attribute, 'Größe ' || p_brand AS text FROM part WHERE p_partkey % 10 = 5").replace('i AS (', 'WITH j AS (').replace('FROM i)', 'FROM j)').replace('x AS (', 'y AS (')} SELECT * FROM y)) GROUP BY 1")
def index_refresh(spark, d):
    """An index after a fifth of its documents changed: half of them have no text any more."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    entries = S.index(part.select(k.alias("id"), "p_name", "p_type"), ["p_name", "p_type"])
    changed = part.filter(k % 5 == 0).select(k.alias("id"), F.when(k % 10 == 5, F.concat(F.lit("Größe "), F.col("p_brand"))).alias("p_name"), F.lit(None).cast("string").alias("p_type"))
    return S.refreshed(entries, changed, ["p_name", "p_type"]).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS}, {_hits_sql('msall ring econmoyy', True)} SELECT * FROM hits ORDER BY {_ORDER}, id LIMIT 200")
def search_typo(spark, d):
    return S.ranked(_part_hits(spark, d, "msall ring econmoyy", typos=True), 200)


@query(f"WITH {_PARTS}, {_hits_sql('small ring economy')} SELECT id, CAST(place AS INTEGER) AS place, total FROM (SELECT id, row_number() OVER (ORDER BY {_ORDER}, id) AS place, count(*) OVER () AS total FROM hits) WHERE place BETWEEN 51 AND 100")
def search_page(spark, d):
    hits = _part_hits(spark, d, "small ring economy")
    page, _ = S.page(hits, 50, 50)
    return page.select("id", "place").crossJoin(hits.agg(F.count("*").alias("total")))  # one row


# Event documents: what the ledger says, with names, places and hosts that follow from the ids.
_TITLES = ["Live music night", "Kids in the park", "Meet-up for a work day", "Farmers market & show", "Film screening: no cost", "Yoga class", "Free concert", "Trail walk", "Book talk"]
_EVENTS = f"""{LEDGER}, ev AS (SELECT l.*, {_TITLES}[CAST(id % 9 + 1 AS INTEGER)] || ' ' || id % 50 AS name, CASE WHEN id % 4 = 0 THEN 'Bring a friend to the ' || category || ' workshop' END AS description,
  CASE WHEN id % 5 <> 0 THEN 'Hall ' || id % 30 END AS venue, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN '1 Main St' END AS street, CASE WHEN id % 5 <> 0 THEN ['Lyons', 'Boulder', 'Denver'][CAST(id % 3 + 1 AS INTEGER)] END AS locality,
  CASE WHEN id % 5 <> 0 THEN 'CO' END AS region_name, id % 11 = 0 AS private, CASE WHEN id % 4 = 1 THEN 'city' ELSE 'exact' END AS precision, CASE WHEN id % 8 = 3 THEN ['exactLocation'] END AS gated_fields,
  CASE WHEN id % 10 = 0 THEN 'virtual' ELSE 'inperson' END AS mode, 'host' || host || '.example' AS handle, CASE WHEN host % 2 = 0 THEN 'Host number ' || host ELSE '' END AS host_name, 'ics' AS platform, h.region, CASE WHEN id % 2 = 0 THEN 'at://x/y/' || id END AS public_uri
  FROM ledger l JOIN host h USING (host)),
co AS (SELECT *, coalesce(venue, street, locality) IS NOT NULL AS stated, visibility = 'gated' OR private OR precision <> 'exact' OR coalesce(list_contains(gated_fields, 'exactLocation'), false) AS hide FROM ev),
docs AS (SELECT id, name, coalesce(description, '') AS description, CASE WHEN NOT stated THEN CASE WHEN mode = 'virtual' THEN 'Online' ELSE '' END WHEN hide THEN concat_ws(', ', locality, region_name) ELSE concat_ws(', ', venue, street, locality) END AS place,
  coalesce(locality, '') AS locality, handle, CASE WHEN host_name <> '' THEN host_name ELSE handle END AS host_name, platform, category, tags, region, CAST(epoch(date_trunc('second', starts_at)) AS BIGINT) AS starts_unix, CAST(epoch(date_trunc('second', ends_at)) AS BIGINT) AS ends_unix, visibility, state,
  CASE WHEN NOT (stated AND hide) AND visibility = 'public' THEN lat END AS lat, CASE WHEN NOT (stated AND hide) AND visibility = 'public' THEN lon END AS lon, CASE WHEN public_uri IS NOT NULL THEN CAST(id AS VARCHAR) END AS rkey FROM co WHERE {GUARD})"""
_DOC_INDEX = _index_sql(" UNION ALL ".join(f"SELECT id, {n} AS attribute, {c} AS text FROM docs" for n, c in enumerate(["name", "array_to_string(tags, ' . ')", *S.ATTRIBUTES[2:]])))


def _events(spark, d):
    n, c = F.col("id"), F.col
    some = n % 5 != 0
    return ledger(spark, d).join(V.host(spark, d), "host").withColumns({
        "name": F.concat(F.get(F.array(*map(F.lit, _TITLES)), (n % 9).cast("int")), F.lit(" "), n % 50), "description": F.when(n % 4 == 0, F.concat(F.lit("Bring a friend to the "), "category", F.lit(" workshop"))),
        "venue": F.when(some, F.concat(F.lit("Hall "), n % 30)), "street": F.when((n % 3 == 0) & some, "1 Main St"), "locality": F.when(some, F.get(F.array(*map(F.lit, ["Lyons", "Boulder", "Denver"])), (n % 3).cast("int"))),
        "region_name": F.when(some, "CO"), "private": n % 11 == 0, "precision": F.when(n % 4 == 1, "city").otherwise("exact"), "gated_fields": F.when(n % 8 == 3, F.array(F.lit("exactLocation"))),
        "mode": F.when(n % 10 == 0, "virtual").otherwise("inperson"), "handle": F.concat(F.lit("host"), c("host"), F.lit(".example")), "host_name": F.when(c("host") % 2 == 0, F.concat(F.lit("Host number "), c("host"))).otherwise(""),
        "platform": F.lit("ics"), "public_uri": F.when(n % 2 == 0, F.concat(F.lit("at://x/y/"), n)),
    })


@query(f"WITH {_EVENTS} SELECT * REPLACE (array_to_string(tags, ',') AS tags) FROM docs")
def search_document(spark, d):
    return S.document(_events(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_EVENTS} SELECT (SELECT count(*) FROM docs) AS indexed, (SELECT count(*) FROM ledger WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM docs)) AS removed")
def index_sync(spark, d):
    return S.synced(ledger(spark, d).filter("id % 3 = 0"), _events(spark, d))[1]


@query(f"WITH {_EVENTS}, {_DOC_INDEX}, {_hits_sql('the kids show meet up')} SELECT hits.* FROM hits JOIN docs USING (id) ORDER BY {_ORDER}, starts_unix, id LIMIT 300")
def search_synonym(spark, d):
    docs = S.document(_events(spark, d))
    found = S.search(S.document_index(docs), "the kids show meet up")
    return S.ranked(found.join(docs.select("id", "starts_unix"), "id"), 300, then=("starts_unix", "id")).drop("starts_unix")


@query(f"""WITH {_EVENTS} SELECT id, starts_unix FROM docs WHERE starts_unix >= epoch({T0} - INTERVAL 3 HOUR)
AND 2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(40.015)) / 2), 2) + cos(radians(lat)) * cos(radians(40.015)) * pow(sin((radians(lon) - radians(-105.27)) / 2), 2))) <= 25""")
def search_radius(spark, d):
    return S.narrowed(S.document(_events(spark, d)), now(), near_to=(40.015, -105.27)).select("id", "starts_unix")


@query(f"WITH {_EVENTS} SELECT id, starts_unix FROM docs WHERE starts_unix >= epoch({T0} - INTERVAL 3 HOUR) AND starts_unix <= epoch({T0} + INTERVAL 10 DAY) AND region = 'AMERICA' AND (category = 'music' OR list_contains(tags, 'music'))")
def search_filters(spark, d):
    return S.narrowed(S.document(_events(spark, d)), now(), end=now() + F.expr("interval 10 days"), region="AMERICA", category="music").select("id", "starts_unix")


@query(f"""WITH {_EVENTS}, {_DOC_INDEX}, {_hits_sql('live music show')},
r AS (SELECT id, row_number() OVER (ORDER BY {_ORDER}, id) AS nr FROM hits JOIN docs USING (id) WHERE starts_unix >= epoch({T0} - INTERVAL 3 HOUR) QUALIFY nr <= 200),
w AS (SELECT id, nr AS place, row_number() OVER (PARTITION BY id % 40 ORDER BY id % 2, id) AS nth FROM r JOIN ledger USING (id) WHERE {GUARD})
SELECT id, CAST(place AS INTEGER) AS place FROM w WHERE nth = 1""")
def search_results(spark, d):
    """Hits drive what is read: the first page of a search, read from the ledger, without duplicates (here: equal urls)."""
    docs = S.narrowed(S.document(_events(spark, d)), now())
    hits, _ = S.page(S.search(S.document_index(docs), "live music show"), 200)
    n = F.col("id")
    rows = S.fetched(hits, ledger(spark, d)).withColumns({"url": F.concat(F.lit("u"), n % 40), "day": F.to_date(F.lit("2024-01-01")), "title": F.concat(F.lit("t"), n % 40), "rank": n % 2, "published_at": n})
    return S.collapsed(rows).select("id", "place")


@query(f"WITH {_EVENTS} SELECT id FROM ev WHERE {GUARD} AND contains(lower(concat_ws(' ', name, coalesce(venue, ''), coalesce(description, ''), host_name)), 'music night 1')")
def search_fallback(spark, d):
    return S.containing(D.public(_events(spark, d)), "Music Night 1", "name", "venue", "description", "host_name").select("id")


# --- venues and places -----------------------------------------------------------------------------

_VENUE = f"""array_to_string(list_filter(string_split(regexp_replace(replace(regexp_replace(translate(lower(coalesce(%s, '')), '{T.ACCENTED}', '{T.PLAIN}'), '[''‘’ʼ]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '{N.NOISE}')), ' ')"""
_NAMED = f"""v AS (SELECT p_partkey AS venue, CASE p_partkey % 4 WHEN 0 THEN 'The Old Brick ' || p_name || ' Hall On North Main Street' WHEN 1 THEN upper(p_name) ELSE p_name || chr(39) || 's ' || p_size END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN ['Café ' || p_name || ' & ' || p_partkey, 'xy'] END AS aliases FROM part),
k AS (SELECT DISTINCT venue, {_VENUE % 'x'} AS key FROM (SELECT venue, unnest(list_concat([name], coalesce(aliases, []))) AS x FROM v)),
t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'At the old brick ' || p_name || ' hall, on North Main Street, CO 80302' WHEN 1 THEN 'Cafe ' || p_name || ' and ' || (p_partkey - p_partkey % 3) ELSE 'At ' || p_name || 's ' || p_size || ' & more' END AS text FROM part),
h AS (SELECT id, venue, key FROM (SELECT id, ' ' || {_VENUE % 'text'} || ' ' AS text FROM t) JOIN k ON contains(text, ' ' || key || ' ') WHERE length(key) >= 3)"""


@query(f"WITH {_NAMED} SELECT id, struct_extract(b, 1) AS venue, struct_extract(b, 2) AS key FROM (SELECT id, arg_max((venue, key), (length(key), -venue)) AS b FROM h GROUP BY 1)")
def venue_match(spark, d):
    n, name, p = F.col("p_partkey"), F.col("p_name"), table(spark, d, "part")
    own = F.when(n % 4 == 0, F.concat(F.lit("The Old Brick "), name, F.lit(" Hall On North Main Street"))).when(n % 4 == 1, F.upper(name)).otherwise(F.concat(name, F.lit("'s "), "p_size"))
    venues = p.select(n.alias("venue"), own.alias("name"), F.when(n % 3 == 0, F.array(F.concat(F.lit("Café "), name, F.lit(" & "), n), F.lit("xy"))).alias("aliases"))
    said = F.when(n % 5 == 0, F.concat(F.lit("At the old brick "), name, F.lit(" hall, on North Main Street, CO 80302"))).when(n % 5 == 1, F.concat(F.lit("Cafe "), name, F.lit(" and "), n - n % 3)).otherwise(F.concat(F.lit("At "), name, F.lit("s "), "p_size", F.lit(" & more")))
    return N.venue_match(p.select(n.alias("id"), said.alias("text")), venues)


@query(f"""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN 'virtual' ELSE 'inperson' END AS mode, event_id % 7 = 0 AS all_day, CASE WHEN event_id % 5 <> 0 THEN 'America/New_York' ELSE '{ZONE}' END AS tz,
  CASE WHEN event_id % 4 <> 0 THEN 39.0 + event_id % 30 / 10.0::DOUBLE END AS lat, CASE WHEN event_id % 4 <> 0 THEN -106.0 + event_id % 20 / 10.0::DOUBLE END AS lon FROM events),
b AS (SELECT *, coalesce(lat BETWEEN 39.5 AND 40.4 AND lon BETWEEN -105.8 AND -104.8, false) AS here FROM e), r AS (SELECT *, here AND mode <> 'virtual' AND NOT all_day AND tz <> '{ZONE}' AS put FROM b)
SELECT id, CASE WHEN put THEN '{ZONE}' ELSE tz END AS tz, put AS tz_inferred, CASE WHEN here THEN lat END AS lat, CASE WHEN here THEN lon END AS lon FROM r""")
def zone_relabel(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select(
        n.alias("id"), F.when(n % 6 == 0, "virtual").otherwise("inperson").alias("mode"), (n % 7 == 0).alias("all_day"), F.when(n % 5 != 0, "America/New_York").otherwise(ZONE).alias("tz"),
        F.when(n % 4 != 0, 39.0 + n % 30 / 10.0).alias("lat"), F.when(n % 4 != 0, -106.0 + n % 20 / 10.0).alias("lon"), F.lit(False).alias("tz_inferred"),
    )
    return N.without_stray_pins(N.relabelled(e, ZONE)).select("id", "tz", "tz_inferred", "lat", "lon")


_ROOMS = """g AS (SELECT s_suppkey AS venue, 'Hall ' || s_name AS name, '1 Main St' AS street, CASE WHEN s_suppkey % 2 = 0 THEN 'Lyons' END AS locality, 'CO' AS region, 40.0::DOUBLE AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 'city' ELSE 'exact' END AS precision FROM supplier),
n AS (SELECT count(*) AS n FROM supplier),
e AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'virtual' ELSE 'inperson' END AS mode, CASE event_id % 4 WHEN 0 THEN 'hall supplier#' || lpad(CAST(event_id % n AS VARCHAR), 9, '0') WHEN 1 THEN 'Room ' || event_id % 10 WHEN 2 THEN 'Boulder room' END AS name,
  CASE WHEN event_id % 8 = 3 THEN event_id % 50 || ' Elm St' END AS street, CASE WHEN event_id % 5 = 0 THEN 'Nederland' END AS locality, CASE WHEN event_id % 7 = 0 THEN 40.1::DOUBLE END AS lat,
  CASE WHEN event_id % 3 = 0 THEN event_id % n END AS hint, event_id % 4 = 0 AS named, event_id % n AS own FROM events, n)"""


@query(f"""WITH {_ROOMS},
w AS (SELECT *, CASE WHEN mode <> 'virtual' THEN nullif(concat_ws(', ', name, street, locality), '') END AS words FROM e),
j AS (SELECT w.*, v.venue IS NOT NULL AS has_v, h.venue IS NOT NULL AS has_h, v.name AS vn, v.street AS vs, v.locality AS vl, v.lat AS va, v.precision AS vp, h.name AS hn, h.street AS hs, h.locality AS hl, h.lat AS ha
  FROM w LEFT JOIN g v ON w.words IS NOT NULL AND w.named AND w.own = v.venue LEFT JOIN g h ON w.words IS NOT NULL AND w.hint = h.venue),
k AS (SELECT *, NOT has_v AND has_h AND street IS NULL AND locality IS NULL AND lat IS NULL AS bare FROM j),
p AS (SELECT id, words, bare, CASE WHEN bare THEN CASE WHEN name <> hn THEN hn || ', ' || name ELSE hn END ELSE coalesce(vn, name) END AS name, CASE WHEN bare THEN hs ELSE coalesce(street, vs) END AS street, CASE WHEN bare THEN hl ELSE coalesce(locality, vl) END AS locality,
  CASE WHEN bare OR has_v THEN 'CO' END AS region, CASE WHEN bare THEN ha ELSE coalesce(lat, va) END AS lat, CASE WHEN has_v AND vp <> 'exact' THEN 'neighborhood' ELSE 'exact' END AS precision,
  coalesce(words = id % 50 || ' Elm St', false) AND id % 50 < 25 AS cached FROM k),
q AS (SELECT * REPLACE (CASE WHEN lat IS NULL AND cached AND NOT bare THEN 40.2 ELSE lat END AS lat, CASE WHEN lat IS NULL AND cached AND NOT bare AND id % 50 % 2 = 1 THEN 'city' ELSE precision END AS precision) FROM p)
SELECT id, name, street, CASE WHEN locality IS NULL AND contains(lower(words), 'boulder') THEN 'Boulder' ELSE locality END AS locality, CASE WHEN locality IS NULL AND contains(lower(words), 'boulder') THEN 'CO' ELSE region END AS region, lat, precision FROM q""")
def merge_places(spark, d):
    """Places of events from a gazetteer of suppliers' halls and a cache of street addresses."""
    k, n = F.col("s_suppkey"), F.col("event_id")
    supplier = table(spark, d, "supplier")
    halls = supplier.select(
        k.alias("venue"), F.concat(F.lit("Hall "), "s_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("1 Main St").alias("street"), F.when(k % 2 == 0, "Lyons").alias("locality"),
        F.lit("CO").alias("region"), F.lit(40.0).alias("lat"), F.lit(-105.0).alias("lon"), F.when(k % 3 == 0, "city").otherwise("exact").alias("precision"),
    )
    number = F.lpad((n % supplier.count()).cast("string"), 9, "0")
    events = table(spark, d, "events").select(
        n.alias("id"), F.when(n % 9 == 0, "virtual").otherwise("inperson").alias("mode"), F.when(n % 4 == 0, F.concat(F.lit("hall supplier#"), number)).when(n % 4 == 1, F.concat(F.lit("Room "), n % 10)).when(n % 4 == 2, "Boulder room").alias("name"),
        F.when(n % 8 == 3, F.concat(n % 50, F.lit(" Elm St"))).alias("street"), F.when(n % 5 == 0, "Nederland").alias("locality"), F.lit(None).cast("string").alias("region"),
        F.when(n % 7 == 0, 40.1).when(n % 7 == 1, 10.0).alias("lat"), F.when(n % 7 < 2, -105.1).alias("lon"), F.lit("exact").alias("precision"), F.when(n % 3 == 0, F.concat(F.lit("The Hall Supplier#"), number)).alias("hint"),
    )
    streets = events.filter("street is not null and id % 50 < 25").select((F.col("id") % 50).alias("x")).distinct()
    cache = streets.select(F.concat("x", F.lit(" elm st")).alias("key"), F.lit(40.2).alias("lat"), F.lit(-105.2).alias("lon"), F.when(F.col("x") % 2 == 1, "city").otherwise("exact").alias("precision"))
    return N.placed(events, halls, cache, "Boulder", "CO").select("id", "name", "street", "locality", "region", "lat", "precision")


@query("""WITH e AS (SELECT event_id AS id, event_id % 5 AS k, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT id, CASE WHEN k IN (1, 2) THEN u || ' N Main St' END AS street, CASE WHEN k IN (1, 2) THEN 'Lyons' END AS locality, CASE WHEN k = 1 THEN 'CO' END AS region, CASE WHEN k = 1 THEN '80540' END AS postal_code, CASE WHEN k IN (1, 3) THEN 'Hall ' || u END AS venue FROM e""")
def address_split(spark, d):
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    line = F.when(n % 5 == 0, "Online").when(n % 5 == 1, F.concat(F.lit("Hall "), u, F.lit(", "), u, F.lit(" N Main St, Lyons, CO 80540"))).when(n % 5 == 2, F.concat(u, F.lit(" N Main St, Lyons"))).when(n % 5 == 3, F.concat(F.lit("Hall "), u))
    return table(spark, d, "events").select(n.alias("id"), N.address(line).alias("a")).select("id", "a.*")


@query("""WITH e AS (SELECT event_id AS id, event_id % 6 AS k, CAST(user_id AS VARCHAR) AS u, 'Nation ' || user_id % 25 AS t, user_id % 25 < 20 AS known FROM events)
SELECT id, CASE k WHEN 0 THEN u || ' N Main St' WHEN 1 THEN u || ' Arapahoe Ave' WHEN 2 THEN u || ' Walnut St' END AS street, CASE WHEN known AND k IN (0, 1, 3, 4) THEN t END AS locality, CASE WHEN k IN (0, 1) THEN 'CO' END AS region,
CASE WHEN k = 0 THEN '80540' END AS postal_code, CASE k WHEN 0 THEN 'Hall 7' WHEN 2 THEN 'The Center' WHEN 3 THEN CASE WHEN NOT known THEN t END WHEN 4 THEN CASE WHEN known THEN 'Library' ELSE 'Library ' || t END END AS venue FROM e""")
def address_towns(spark, d):
    """Lines with and without separators, whose towns are those of a table: twenty of the nations."""
    n, u, t = F.col("event_id"), F.col("user_id").cast("string"), F.concat(F.lit("nation "), (F.col("user_id") % 25).cast("string"))
    k, say = n % 6, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    # towns that the table lacks keep their spelling, others take the table's
    spelt = F.when(F.col("user_id") % 25 < 20, t).otherwise(F.initcap(t))
    line = F.when(k == 0, say("Hall 7, ", u, " N Main St, ", spelt, ", CO 80540")).when(k == 1, say(u, " Arapahoe Ave ", spelt, " CO")).when(k == 2, say("The Center • ", u, " Walnut St")).when(k == 3, spelt).when(k == 4, say("Library ", spelt)).otherwise("TBA")
    towns = table(spark, d, "nation").filter("n_nationkey < 20").select(F.initcap(F.translate("n_name", "_", " ")).alias("name"))
    rows = table(spark, d, "events").select(n.alias("id"), line.alias("line"))
    return N.with_towns(rows, "id", "line", towns).select("id", N.address(F.col("line"), F.col("town")).alias("a")).select("id", "a.*")
