"""Every query of the event engine with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import classify as C
from ..operators import directory as D
from ..operators import duplicates as G
from ..operators import enrich as N
from ..operators import reconcile as R
from ..operators import search as S
from ..operators import upkeep as K
from ..operators import versions as X
from . import views as V
from .views import LEDGER, NOW, SNAPS, ZONE, ledger, now, snapshot, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LOCAL = f"CAST((starts_at AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE)"
T0 = f"TIMESTAMP '{NOW}'"
GUARD = "state IN ('live', 'cancelled') AND visibility IN ('public', 'gated')"
WINDOW = f"starts_at BETWEEN {T0} - INTERVAL 3 HOUR AND {T0} + INTERVAL 120 DAY"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _open(spark: SparkSession, d: str) -> DataFrame:
    return D.window(D.public(ledger(spark, d)), now())


# --- directory -------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT {LOCAL} AS day, count(*) AS n FROM ledger JOIN host USING (host) WHERE region = 'AMERICA' AND {GUARD} AND {WINDOW} GROUP BY 1")
def day_counts(spark, d):
    return D.day_counts(D.in_region(_open(spark, d), V.host(spark, d), "AMERICA"), ZONE)


@query(f"WITH {LEDGER} SELECT {LOCAL} AS day, count(*) AS n FROM ledger WHERE {GUARD} AND {WINDOW} AND (category = 'music' OR list_contains(tags, 'music')) GROUP BY 1")
def day_counts_category(spark, d):
    return D.day_counts(D.tagged(_open(spark, d), "music"), ZONE)


@query(f"WITH {LEDGER} SELECT id, starts_at, category FROM ledger WHERE {GUARD} AND {WINDOW} ORDER BY starts_at, id LIMIT 100")
def browse_page(spark, d):
    return D.page(_open(spark, d), 100).select("id", "starts_at", "category")


@query(f"""WITH {LEDGER}, o AS (SELECT * FROM ledger WHERE {GUARD} AND {WINDOW}), c AS (SELECT starts_at AS s, id AS i FROM (SELECT * FROM o ORDER BY starts_at, id LIMIT 100) ORDER BY s DESC, i DESC LIMIT 1)
SELECT id, starts_at, category FROM o, c WHERE (starts_at, id) > (s, i) ORDER BY starts_at, id LIMIT 100""")
def browse_next_page(spark, d):
    first = D.page(_open(spark, d), 100).select("starts_at", "id").orderBy(F.desc("starts_at"), F.desc("id")).first()
    return D.page(D.after(_open(spark, d), F.lit(first.starts_at).cast("timestamp_ntz"), F.lit(first.id)), 100).select("id", "starts_at", "category")


@query(f"WITH {LEDGER} SELECT id, starts_at, state FROM ledger WHERE host = 7 ORDER BY starts_at, id LIMIT 51")
def owner_page(spark, d):
    return D.page(ledger(spark, d).filter("host = 7"), 51).select("id", "starts_at", "state")


@query(f"""WITH {LEDGER} SELECT source, count(*) FILTER (state = 'live' AND r) AS live, count(*) FILTER (state = 'cancelled' AND r) AS cancelled, count(*) FILTER (state = 'held' AND r) AS held
FROM (SELECT *, starts_at > {T0} - INTERVAL 1 DAY AS r FROM ledger) GROUP BY 1""")
def source_state_counts(spark, d):
    return D.state_counts(ledger(spark, d), now())


@query(f"""WITH {LEDGER} SELECT * FROM (SELECT host, count(*) FILTER (starts_at > {T0} - INTERVAL 31 DAY AND starts_at <= {T0}) AS new_rows, count(*) FILTER (starts_at > {T0} AND state = 'live') AS upcoming FROM ledger GROUP BY 1)
WHERE new_rows > 0 OR upcoming > 0""")
def digest(spark, d):
    return D.digest(ledger(spark, d), now())


@query(f"""WITH {LEDGER} SELECT count(DISTINCT host) AS hosts, count(*) FILTER (state = 'live' AND starts_at > {T0}) AS upcoming, count(*) FILTER (state = 'live' AND starts_at > {T0} AND has_image) AS with_image,
max(CASE WHEN starts_at <= {T0} THEN starts_at END) AS latest FROM ledger""")
def stats(spark, d):
    return D.stats(ledger(spark, d), now())


@query(f"WITH {LEDGER} SELECT lat, lon, count(*) AS n, min(starts_at) AS first_start, arg_min(id, (starts_at, id)) AS first_id FROM ledger WHERE {GUARD} GROUP BY lat, lon")
def places(spark, d):
    return D.places(D.public(ledger(spark, d)))


@query(f"""WITH {LEDGER}, o AS (SELECT *, row_number() OVER (ORDER BY lat) AS a, row_number() OVER (ORDER BY lon) AS b, count(*) OVER () AS n FROM ledger WHERE {GUARD})
SELECT min(CASE WHEN a = floor(0.05 * (n - 1)) + 1 THEN lat END) - 0.01 AS lat_min, min(CASE WHEN a = floor(0.95 * (n - 1)) + 1 THEN lat END) + 0.01 AS lat_max,
  min(CASE WHEN b = floor(0.05 * (n - 1)) + 1 THEN lon END) - 0.01 AS lon_min, min(CASE WHEN b = floor(0.95 * (n - 1)) + 1 THEN lon END) + 0.01 AS lon_max FROM o""")
def map_frame(spark, d):
    return D.map_frame(D.public(ledger(spark, d)))


@query(f"""WITH {LEDGER}, k AS (SELECT id, 2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(40.015)) / 2), 2) + cos(radians(lat)) * cos(radians(40.015)) * pow(sin((radians(lon) - radians(-105.27)) / 2), 2))) AS x FROM ledger WHERE {GUARD})
SELECT id, round(x, 3) AS km FROM k WHERE x <= 10""")
def near_me(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    found = D.public(ledger(spark, d)).filter(P.near(lat, lon, 40.015, -105.27, 10))
    return found.select("id", F.round(P.distance_km(lat, lon, 40.015, -105.27), 3).alias("km"))


@query(f"""WITH {LEDGER}, x AS (SELECT id, {LOCAL} AS d, CAST(({T0} AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE) AS t FROM ledger WHERE {GUARD}),
y AS (SELECT *, t - CAST(isodow(t) - 1 AS INTEGER) AS m FROM x)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d = t THEN 'tonight' WHEN d BETWEEN m + 4 AND m + 6 AND d >= t THEN 'weekend' WHEN d > t AND d <= t + 7 THEN 'week' WHEN d > t THEN 'later' ELSE 'past' END AS bucket FROM y) GROUP BY 1""")
def buckets(spark, d):
    return D.public(ledger(spark, d)).groupBy(D.bucket(F.col("starts_at"), now(), ZONE).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER}, n AS (SELECT {LOCAL} AS day, count(*) AS n FROM ledger WHERE {GUARD} GROUP BY 1), c AS (SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS day FROM range(42) t(i))
SELECT day, coalesce(n, 0) AS n, month(day) = 1 AS in_month FROM c LEFT JOIN n USING (day)""")
def month_grid(spark, d):
    return D.month_grid(D.day_counts(D.public(ledger(spark, d)), ZONE), "2024-01-01")


@query(f"""WITH {LEDGER}, n AS (SELECT {LOCAL} AS day, count(*) AS n FROM ledger WHERE {GUARD} GROUP BY 1)
SELECT day, n, CAST(greatest(12, round(100.0 * n / max(n) OVER ())) AS INTEGER) AS bar FROM n WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'""")
def week_strip(spark, d):
    return D.week_strip(D.day_counts(D.public(ledger(spark, d)), ZONE), "2024-01-15")


@query(f"""WITH {LEDGER}, r AS (SELECT {LOCAL} AS day, id, row_number() OVER (PARTITION BY {LOCAL} ORDER BY starts_at, id) AS place, count(*) OVER (PARTITION BY {LOCAL}) AS total FROM ledger WHERE {GUARD})
SELECT day, CAST(place AS INTEGER) AS place, id, greatest(total - 3, 0) AS more FROM r WHERE place <= 3""")
def day_cells(spark, d):
    return D.day_cells(D.public(ledger(spark, d)), ZONE)


# --- text and links --------------------------------------------------------------------------------

_CANON = r"""
p AS (SELECT page_id, url, regexp_extract(trim(url), '^([a-zA-Z]+)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS u FROM pages),
q AS (SELECT page_id, url, lower(u.s) AS s, regexp_replace(lower(u.h), '^www\.', '') AS h, u.p AS p,
  array_to_string(list_filter(string_split(u.q, '&'), lambda x: x <> '' AND NOT list_contains(%s, lower(string_split(x, '=')[1]))), '&') AS a FROM p),
canon AS (SELECT page_id, url, h AS domain, CASE WHEN p = '/' AND a = '' THEN s || '://' || h WHEN p <> '/' THEN regexp_replace(s || '://' || h || p || CASE WHEN a <> '' THEN '?' || a ELSE '' END, '/$', '') ELSE s || '://' || h || p || '?' || a END AS canonical FROM q)
""" % U.TRACKING


@query(f"WITH {_CANON} SELECT page_id, canonical FROM canon")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(f"WITH {_CANON} SELECT domain, count(*) AS n, count(DISTINCT canonical) AS urls FROM canon GROUP BY 1")
def url_domains(spark, d):
    p = table(spark, d, "pages").select(U.domain(F.col("url")).alias("domain"), U.canonical(F.col("url")).alias("u"))
    return p.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("u").alias("urls"))


@query(f"WITH {_CANON}, i AS (SELECT domain, url, 'img' || (page_id % 4) AS image FROM canon) SELECT domain, image, count(DISTINCT url) AS n, count(DISTINCT url) >= 3 AS is_default FROM i GROUP BY ALL")
def image_reuse(spark, d):
    p = table(spark, d, "pages").select(U.domain(F.col("url")).alias("domain"), "url", F.concat(F.lit("img"), F.col("page_id") % 4).alias("image"))
    return N.image_reuse(p)


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[email removed]', 'gi'), '(?:\+?1[\s.-]?)?\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b', '[phone removed]', 'g')) AS redacted FROM documents""")
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) AS emails, len(list_distinct(regexp_extract_all(text, '(?:\+?1[\s.-]?)?\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b'))) AS phones FROM documents""")
def contacts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.emails(t)).cast("long").alias("emails"), F.size(T.phones(t)).cast("long").alias("phones"))


@query(r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[#*_>`]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 280 THEN t ELSE regexp_replace(t[:279], '\s+\S*$', '') || '...' END AS excerpt FROM p""")
def excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


_TITLE = f"""array_to_string(list_filter(string_split(trim(regexp_replace(replace(translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: NOT list_contains({T.TITLE_STOPS.split("|")}, w)), ' ')"""


@query(f"SELECT doc_id, sha256({_TITLE % 'text'}) AS title FROM documents")
def norm_title(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.norm_title(F.col("text")), 256).alias("title"))


def _rules(c: str) -> str:
    return ", ".join("CASE WHEN regexp_matches(lower(%s), '%s') THEN '%s' END" % (c, p.replace("'", "''"), n) for n, p in T.CATEGORY_RULES)


def _tagged(c: str) -> str:
    return "CASE lower(trim(%s)) %s END" % (c, " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in T.TAG_CATEGORIES.items()))


@query(f"""WITH {LEDGER} SELECT id, coalesce({_tagged('tags[1]')}, {_tagged('tags[2]')}, {_rules('name')}, {_rules('tags[1]')}, {_rules('tags[2]')}, {_rules('body')}) AS category
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN list_transform(tags, lambda t: CASE WHEN t IN ('music', 'tech') THEN ' Kids ' ELSE t || ' walkers' END) ELSE list_transform(tags, lambda t: t || ' jam') END AS tags,
  CASE WHEN id % 4 = 0 THEN 'Open mic' ELSE 'Night ' || id END AS name, repeat('long ', CAST(id % 130 AS INTEGER)) || 'farmers market' AS body FROM ledger)""".replace("lower(body)", "lower(substr(body, 1, 600))"))
def categorize(spark, d):
    e, n = ledger(spark, d), F.col("id")
    tags = F.when(n % 3 == 0, F.transform("tags", lambda t: F.when(t.isin("music", "tech"), " Kids ").otherwise(F.concat(t, F.lit(" walkers"))))).otherwise(F.transform("tags", lambda t: F.concat(t, F.lit(" jam"))))
    name, body = F.when(n % 4 == 0, "Open mic").otherwise(F.concat(F.lit("Night "), n)), F.concat(F.repeat(F.lit("long "), (n % 130).cast("int")), F.lit("farmers market"))
    return e.select("id", tags.alias("tags"), name.alias("name"), body.alias("body")).select("id", T.categorize(F.col("name"), F.col("body"), F.col("tags")).alias("category"))


@query(f"SELECT p_partkey, coalesce({_rules('p_name')}, {_rules('substr(p_type, 1, 600)')}) AS category FROM part")
def categorize_untagged(spark, d):
    return table(spark, d, "part").select("p_partkey", T.categorize(F.col("p_name"), F.col("p_type")).alias("category"))


@query(f"""SELECT event_id, 'h_' || substr(sha256({_TITLE % "'The ' || event_type || ' at ' || user_id"} || chr(0) || strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(0) || CASE WHEN user_id % 2 = 0 THEN 'hall ' || user_id ELSE '' END), 1, 24) AS identity,
'ics:http://x/' || user_id AS fingerprint FROM events""")
def identities(spark, d):
    n = F.col("user_id")
    title, place = F.concat(F.lit("The "), "event_type", F.lit(" at "), n), F.when(n % 2 == 0, F.concat(F.lit(" Hall "), n))
    return table(spark, d, "events").select("event_id", T.fallback_identity(title, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), place).alias("identity"), T.source_fingerprint(F.lit("ics"), F.concat(F.lit(" HTTP://x/"), n)).alias("fingerprint"))


_LINKED = "(SELECT page_id, 'See ' || url || ', or https://us04.zoom.us/j/' || page_id || '. Übrigens ' || url || ' too' AS text FROM pages)"
_LINK = r"""https?://[^\s<>()\]"'']+[^\s<>()\]"''.,;:!?]"""


def _linked(spark, d):
    text = F.concat(F.lit("See "), F.col("url"), F.lit(", or https://us04.zoom.us/j/"), F.col("page_id"), F.lit(". Übrigens "), F.col("url"), F.lit(" too"))
    return table(spark, d, "pages").select("page_id", text.alias("text"))


@query(f"SELECT page_id, n, u AS urls FROM (SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS u FROM (SELECT page_id, list_distinct(regexp_extract_all(text, '{_LINK}')) AS x, list_filter(regexp_extract_all(text, '{_LINK}'), lambda v, i: list_position(regexp_extract_all(text, '{_LINK}'), v) = i) AS l FROM {_LINKED}))")
def extract_urls(spark, d):
    found = U.links(F.col("text"))
    return _linked(spark, d).select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("urls"))


@query(f"SELECT page_id, 'https://us04.zoom.us/j/' || page_id AS join_url, replace(text, 'https://us04.zoom.us/j/' || page_id, '{U.SHARED_LATER}') AS text FROM {_LINKED}")
def scrub_links(spark, d):
    return _linked(spark, d).select("page_id", U.scrub(F.col("text")).alias("s")).select("page_id", "s.*")


@query(f"""WITH l AS (SELECT page_id, text, regexp_extract_all(text, '{_LINK}') AS u, string_split_regex(text, '{_LINK}') AS g FROM {_LINKED}), e AS (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM l)
SELECT page_id, i, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(u[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS byte_start, u[i] AS uri FROM e""")
def facets(spark, d):
    out = _linked(spark, d).select("page_id", F.posexplode(U.facets(F.col("text"))).alias("i", "f"))
    return out.select("page_id", (F.col("i") + 1).cast("long").alias("i"), F.col("f.start").cast("long").alias("byte_start"), F.col("f.uri").alias("uri"))


# --- normalize -------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, (o_orderdate AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS start_utc, ((o_orderdate + INTERVAL 1 DAY) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS end_utc FROM orders")
def all_day_bounds(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", P.wall_to_utc(day, ZONE).alias("start_utc"), P.wall_to_utc(day + F.expr("interval 1 day"), ZONE).alias("end_utc"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS w, event_id % 3 AS k, ts FROM events)
SELECT event_id, date_trunc('second', CASE k WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR ELSE (ts AT TIME ZONE 'America/Denver') AT TIME ZONE 'UTC' END) AS instant FROM t""")
def normalize_times(spark, d):
    from ..operators.normalize import instant

    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(wall, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(wall, F.lit("+02:00"))).otherwise(wall)
    return table(spark, d, "events").select("event_id", instant(raw, F.lit(ZONE)).alias("instant"))


@query(f"SELECT id, CASE WHEN link AND NOT place THEN 'virtual' WHEN link AND place THEN 'hybrid' WHEN NOT place AND has THEN 'virtual' ELSE 'inperson' END AS mode FROM (SELECT event_id AS id, event_id % 3 = 0 AS link, event_id % 4 <> 0 AS place, event_type = 'view' AS has FROM events)")
def mode(spark, d):
    from ..operators.normalize import infer_mode

    e = F.col("event_id")
    words = F.when(F.col("event_type") == "view", "Join online").otherwise("See you there")
    return table(spark, d, "events").select(e.alias("id"), infer_mode(F.lit(None).cast("string"), F.when(e % 3 == 0, "https://zoom.us/j/1"), e % 4 != 0, words).alias("mode"))


@query(f"WITH {LEDGER} SELECT id, sha256(CAST(to_json(struct_pack(external_id := external_id, state := state, visibility := visibility, category := category, tags := CASE WHEN id % 3 <> 0 THEN tags END)) AS VARCHAR)) AS hash FROM ledger")
def content_hash(spark, d):
    e = ledger(spark, d).withColumn("tags", F.when(F.col("id") % 3 != 0, F.col("tags")))
    return e.select("id", R.content_hash("external_id", "state", "visibility", "category", "tags").alias("hash"))


@query(f"WITH {SNAPS} SELECT n.source, n.key FROM snap_new n JOIN snap_old o USING (source, key) WHERE n.price <> o.price OR n.level <> o.level")
def changed_rows(spark, d):
    h = R.content_hash("price", "level")
    a = snapshot(spark, d, True).select("source", "key", h.alias("h"))
    b = snapshot(spark, d, False).select("source", "key", h.alias("g"))
    return a.join(b, ["source", "key"]).filter("h <> g").select("source", "key")


# --- reconcile -------------------------------------------------------------------------------------

# Sources 0, 5, 10 and 15 give the rows that the other sources have lost new keys instead, with titles spelt otherwise, and add none.
_NORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g'), '\b(the|of) ', '', 'g'))"
_ROWS = f"""{SNAPS},
l AS (SELECT *, CASE WHEN status = 'F' AND key % 9 = 0 THEN 'removed' WHEN key % 7 = 0 THEN 'cancelled' WHEN key % 5 = 0 THEN 'held' ELSE 'live' END AS state, key % 2 = 0 AS published, key % 8 = 3 AS from_signal,
  key % 3 AS missing_runs, key % 13 AS missing_hours, key % 11 AS cancelled_days FROM snap_old),
s AS (SELECT * FROM snap_new WHERE NOT (source % 5 = 0 AND key % 10 = 0) UNION ALL SELECT source, key + 1000000000, price, CAST(key % 4 AS INTEGER), starts_at, status, ends_at, 'The ÖRDER, of ' || substr(title, 10) || '!' FROM snap_old WHERE source % 5 = 0 AND key % 10 = 1),
m AS (SELECT * FROM l ANTI JOIN s USING (source, key) WHERE state <> 'removed'), f AS (SELECT * FROM s ANTI JOIN l USING (source, key)),
p AS (SELECT source, old_key, new_key FROM (SELECT source, {_NORM} AS title, starts_at, max(key) AS old_key FROM m GROUP BY ALL) JOIN (SELECT source, {_NORM} AS title, starts_at, min(key) AS new_key FROM f GROUP BY ALL) USING (source, title, starts_at)),
ok AS (SELECT source FROM (SELECT source, count(*) AS m FROM m GROUP BY 1) JOIN (SELECT source, count(*) AS f FROM f GROUP BY 1) USING (source) JOIN (SELECT source, count(*) AS p FROM p GROUP BY 1) USING (source) WHERE m >= 5 AND f >= 5 AND p >= ceil(0.8 * f)),
k AS (SELECT * FROM p SEMI JOIN ok USING (source)),
plan AS (SELECT source, old_key AS key, 'rekey' AS action, new_key FROM k UNION ALL SELECT coalesce(l.source, s.source) AS source, coalesce(l.key, s.key) AS key, CASE
  WHEN l.key IS NULL THEN 'create' WHEN s.key IS NULL AND l.state = 'removed' THEN NULL
  WHEN s.key IS NULL THEN CASE WHEN l.state = 'cancelled' AND l.cancelled_days > 7 THEN 'remove' WHEN coalesce(l.ends_at, l.starts_at) < TIMESTAMP '1998-01-01' OR l.state = 'cancelled' THEN 'leave'
    WHEN l.missing_runs + 1 >= 2 AND l.missing_hours >= 6 THEN 'cancel' ELSE 'missing' END
  WHEN s.level > l.level AND (l.published OR l.state = 'held' OR l.from_signal) THEN 'widen-pending' WHEN l.state = 'removed' THEN 'create'
  WHEN s.level = l.level AND s.price = l.price AND l.state <> 'cancelled' THEN 'touch' ELSE 'update' END AS action, NULL
  FROM (SELECT * FROM l WHERE (source, key) NOT IN (SELECT (source, old_key) FROM k)) l FULL JOIN (SELECT * FROM s WHERE (source, key) NOT IN (SELECT (source, new_key) FROM k)) s ON l.source = s.source AND l.key = s.key)"""


def _sides(spark, d):
    k = F.col("key")
    state = F.when((F.col("status") == "F") & (k % 9 == 0), "removed").when(k % 7 == 0, "cancelled").when(k % 5 == 0, "held").otherwise("live")
    was, now_ = snapshot(spark, d, False), snapshot(spark, d, True)
    common = ("source", "key", "level", R.content_hash("price").alias("hash"), "title", "starts_at", "ends_at")
    old = was.select(
        *common, state.alias("state"), (k % 2 == 0).alias("published"), (k % 8 == 3).alias("from_signal"), F.lit(None).cast("int").alias("widen_to"),
        (k % 3).alias("missing_runs"), (k % 13).alias("missing_hours"), (k % 11).alias("cancelled_days"),
    )
    again = was.filter("source % 5 = 0 and key % 10 = 1").withColumns({"key": k + 1000000000, "level": (k % 4).cast("int"), "title": F.concat(F.lit("The ÖRDER, of "), F.col("title").substr(10, 20), F.lit("!"))})
    new = now_.filter("not (source % 5 = 0 and key % 10 = 0)").unionByName(again).select(*common, (k % 6 == 0).alias("cancelled"))
    return old, new


def _plan(spark, d):
    old, new = _sides(spark, d)
    return R.plan(old, new, F.lit("1998-01-01").cast("timestamp_ntz"))


@query(f"WITH {_ROWS} SELECT source, key, action, new_key FROM plan WHERE action IS NOT NULL")
def reconcile_plan(spark, d):
    return _plan(spark, d)


_NEXT = f"""{_ROWS},
b AS (SELECT *, CASE WHEN state = 'live' AND level >= 3 THEN 'at://' || source || '/' || key END AS public_uri, CASE WHEN level BETWEEN 1 AND 3 THEN 'space://' || source || '/' || key END AS space_uri, key % 17 = 0 AS own FROM l),
j AS (SELECT coalesce(b.source, plan.source) AS source, coalesce(b.key, plan.key) AS old_key, coalesce(plan.new_key, b.key, plan.key) AS key, coalesce(action, 'leave') AS a, b.level AS l0, b.state AS s0, b.public_uri AS p0, b.space_uri AS g0, b.own AS o0, b.missing_runs AS r0
  FROM b FULL JOIN plan ON b.source = plan.source AND b.key = plan.key),
t AS (SELECT j.*, s.level AS l1, s.key IS NOT NULL AND a IN ('create', 'update', 'rekey') AS take, s.key % 6 = 0 AS c1, s.key % 19 = 0 AS o1 FROM j LEFT JOIN s ON s.source = j.source AND s.key = j.key),
u AS (SELECT *, CASE WHEN take THEN CASE WHEN l1 >= 3 THEN CASE WHEN o1 THEN 'own://' || key ELSE coalesce(p0, 'at://' || source || '/' || key) END END WHEN a <> 'remove' THEN p0 END AS p1,
  CASE WHEN take THEN CASE WHEN l1 BETWEEN 1 AND 3 THEN 'space://' || source || '/' || key END WHEN a <> 'remove' THEN g0 END AS g1, CASE WHEN take THEN o1 ELSE coalesce(o0, false) END AS own FROM t)"""


def _decided(spark, d):
    """(the ledger with all its columns, reconciled rows)."""
    old, new = _sides(spark, d)
    k = F.col("key")
    name = lambda kind: F.concat(F.lit(kind), "source", F.lit("/"), k)
    ledger_ = old.withColumns({
        "public_uri": F.when((F.col("state") == "live") & (F.col("level") >= 3), name("at://")), "space_uri": F.when(F.col("level").between(1, 3), name("space://")), "own": k % 17 == 0,
        "missing_since": F.lit(None).cast("timestamp_ntz"), "cancelled_at": F.lit(None).cast("timestamp_ntz"), "last_seen": F.lit(None).cast("timestamp_ntz"), "missing_runs": F.col("missing_runs").cast("int"),
    })
    snap = new.withColumn("own_uri", F.when(k % 19 == 0, F.concat(F.lit("own://"), k)))
    return ledger_, R.reconciled(ledger_, snap, F.lit("1998-01-01").cast("timestamp_ntz"))


def _next(spark, d):
    return R.applied(_decided(spark, d)[1], now())


@query(f"""WITH {_NEXT} SELECT source, CASE WHEN take THEN key ELSE old_key END AS key, CASE WHEN take THEN l1 ELSE l0 END AS level,
CASE WHEN take AND l1 = 0 THEN 'held' WHEN take AND c1 THEN 'cancelled' WHEN take THEN 'live' WHEN a = 'cancel' THEN 'cancelled' WHEN a = 'remove' THEN 'removed' ELSE s0 END AS state, p1 AS public_uri, g1 AS space_uri, own,
CASE WHEN a = 'missing' THEN {T0} END AS missing_since, CAST(CASE WHEN a IN ('create', 'update', 'rekey', 'touch', 'widen-pending') OR (a = 'cancel' AND coalesce(p0, g0) IS NOT NULL) THEN 0 WHEN a = 'missing' THEN r0 + 1 ELSE r0 END AS INTEGER) AS missing_runs,
CASE WHEN a IN ('update', 'rekey') AND l1 <> 0 AND c1 THEN {T0} WHEN a = 'cancel' THEN {T0} END AS cancelled_at FROM u""")
def ledger_write(spark, d):
    return _next(spark, d).select("source", "key", "level", "state", "public_uri", "space_uri", "own", "missing_since", "missing_runs", "cancelled_at")


@query(f"""WITH {_NEXT}, n AS (SELECT source, CASE WHEN take THEN key ELSE old_key END AS key, CASE WHEN take THEN l1 ELSE l0 END AS level,
CASE WHEN take AND l1 = 0 THEN 'held' WHEN take AND c1 THEN 'cancelled' WHEN take THEN 'live' WHEN a = 'cancel' THEN 'cancelled' WHEN a = 'remove' THEN 'removed' ELSE s0 END AS state FROM u)
SELECT source, key, level, state, CAST(2 AS BIGINT) AS version FROM n WHERE source % 2 = 0 UNION ALL SELECT source, key, level, state, 2 FROM l WHERE source % 2 = 1 UNION ALL SELECT source, key, level, state, 1 FROM l""")
def ledger_versions(spark, d):
    """Two commits read back: the ledger, and its next version for half of the sources; the first one stays as it was."""
    from .streams import scratch

    folder, (ledger_, decided) = scratch(spark), _decided(spark, d)
    keep = ["source", "key", "level", "state"]
    X.commit(ledger_.select(*keep), folder)
    half = decided.filter("source % 2 = 0")
    R.write(R.applied(half, now()).select(*keep, "withdrawn"), half, folder)
    both = [X.read(spark, folder, n).withColumn("version", F.lit(n).cast("long")) for n in (1, 2)]
    return both[0].unionByName(both[1]).select(*keep, "version")


@query(f"""WITH {_NEXT} SELECT source, CASE WHEN take THEN key ELSE old_key END AS key, x AS record FROM u, LATERAL (SELECT unnest(list_filter([CASE WHEN p0 IS NOT NULL AND p1 IS NULL AND NOT own THEN p0 END,
CASE WHEN g0 IS NOT NULL AND (g1 IS NULL OR (take AND l0 <> l1)) THEN g0 END], lambda y: y IS NOT NULL)) AS x)""")
def teardown(spark, d):
    return _next(spark, d).select("source", "key", F.explode("withdrawn").alias("record"))


@query(f"""WITH {_ROWS} SELECT source, {', '.join(f"count(*) FILTER (action = '{a}') AS {a.replace('-', '_')}" for a in ("create", "update", "touch", "rekey", "widen-pending", "cancel", "missing", "remove", "leave"))} FROM plan WHERE action IS NOT NULL GROUP BY 1""")
def run_counters(spark, d):
    return R.run_counters(_plan(spark, d))


@query(f"WITH {_ROWS} SELECT source, key, CAST(nth AS INTEGER) AS nth, nth > 50 AS deferred FROM (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY key) AS nth FROM plan WHERE action = 'create')")
def create_budget(spark, d):
    return R.create_budget(_plan(spark, d), ["key"], 50).select("source", "key", "nth", "deferred")


@query(f"WITH {_ROWS} SELECT DISTINCT source, key FROM plan WHERE action = 'widen-pending' AND key % 4 <> 0")
def widen_queue(spark, d):
    waiting = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select((F.col("o_custkey") % 20).alias("source"), F.col("o_orderkey").alias("key"))
    return C.widen_queue(_plan(spark, d), waiting)


_CHURN = f"""{SNAPS}, m AS (SELECT source, key, starts_at FROM snap_old), f AS (SELECT source, key + 1000000000 AS key, starts_at FROM snap_old WHERE source % 2 = 0 OR key % 3 = 0
  UNION ALL SELECT source, key + 2000000000, starts_at - INTERVAL 9999 DAY FROM snap_old WHERE source % 3 = 0),
p AS (SELECT source, old_key, new_key FROM (SELECT source, starts_at, max(key) AS old_key FROM m GROUP BY ALL) JOIN (SELECT source, starts_at, min(key) AS new_key FROM f GROUP BY ALL) USING (source, starts_at)),
c AS (SELECT source FROM (SELECT source, count(*) AS m FROM m GROUP BY 1) JOIN (SELECT source, count(*) AS f FROM f GROUP BY 1) USING (source) JOIN (SELECT source, count(*) AS p FROM p GROUP BY 1) USING (source) WHERE m >= 5 AND f >= 5 AND p >= ceil(0.8 * f))"""


@query(f"WITH {_CHURN} SELECT p.* FROM p SEMI JOIN c USING (source)")
def churn(spark, d):
    base = snapshot(spark, d, False).select("source", "key", "starts_at")
    again = base.filter("source % 2 = 0 or key % 3 = 0").withColumn("key", F.col("key") + 1000000000)
    other = base.filter("source % 3 = 0").select("source", (F.col("key") + 2000000000).alias("key"), (F.col("starts_at") - F.expr("interval 9999 day")).alias("starts_at"))
    return R.churn(base, again.unionByName(other), ["starts_at"])


@query(f"""WITH {SNAPS} SELECT n.source, n.key, CASE WHEN o.key IS NULL THEN 'created' WHEN n.level = 0 THEN 'held' WHEN n.price <> o.price THEN 'updated' ELSE 'unchanged' END AS result
FROM snap_new n LEFT JOIN snap_old o USING (source, key)""")
def push_result(spark, d):
    new, old = (snapshot(spark, d, side).withColumn("hash", R.content_hash("price")) for side in (True, False))
    return R.push_results(new, old)


@query(f"SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return R.latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


# --- classification and access ---------------------------------------------------------------------

_NAMED = f"""{LEDGER}, r AS (SELECT * FROM (VALUES (1, 'kit', NULL, 'members', 'crew'), (2, NULL, 'music', 'gated', NULL), (3, NULL, 'food', 'members', NULL), (4, NULL, NULL, 'unlisted', NULL)) t(position, title, cat, level, audience) WHERE position < 4),
e AS (SELECT *, 'event ' || CASE id % 4 WHEN 0 THEN 'Kit' ELSE 'Tin' END AS name, CASE id % 11 WHEN 0 THEN 'private' WHEN 1 THEN 'unlisted' END AS privacy, CASE WHEN id % 3 = 0 THEN 'x' END AS join_url, id % 5 = 0 AS home,
  CASE id % 13 WHEN 0 THEN 'public' WHEN 1 THEN 'held' END AS override_level, id % 17 = 0 AS override_hidden FROM ledger),
f AS (SELECT e.*, (SELECT arg_min((r.level, r.audience), r.position) FROM r WHERE (r.title IS NULL OR contains(lower(e.name), r.title)) AND (r.cat IS NULL OR r.cat = e.category OR list_contains(e.tags, r.cat))) AS rule FROM e)"""
_RANKS = "MAP {'public': 5, 'unlisted': 4, 'gated': 3, 'members': 2, 'invite': 1, 'held': 0}"


@query(f"""WITH {_NAMED}, g AS (SELECT id, rule[1] AS rl, rule[2] AS ra, CASE privacy WHEN 'private' THEN 'held' WHEN 'unlisted' THEN 'unlisted' END AS cap, override_level AS o, override_hidden AS h, join_url, home FROM f),
k AS (SELECT *, coalesce(rl, 'public') AS base, o IS NOT NULL AND NOT coalesce({_RANKS}[o] > {_RANKS}[cap], false) AS chosen FROM g),
m AS (SELECT *, coalesce({_RANKS}[cap] < {_RANKS}[base], false) AS capped FROM k),
n AS (SELECT *, CASE WHEN h THEN 'held' WHEN chosen THEN o WHEN capped THEN cap ELSE base END AS level, CASE WHEN h OR chosen THEN 'per-event' WHEN capped THEN 'source-signal' WHEN rl IS NOT NULL THEN 'rule' ELSE 'host-default' END AS visibility_source FROM m)
SELECT id, CASE WHEN level IN ('members', 'invite') AND ra IS NULL THEN 'held' ELSE level END AS visibility, visibility_source,
  CASE WHEN level = 'gated' AND join_url IS NULL AND NOT home THEN 'exactLocation' ELSE concat_ws(',', CASE WHEN join_url IS NOT NULL THEN 'joinUrl' END, CASE WHEN home THEN 'exactLocation' END) END AS gated FROM n""".replace("rule[1]", "struct_extract(rule, 1)").replace("rule[2]", "struct_extract(rule, 2)"))
def classify(spark, d):
    n = F.col("id")
    e = ledger(spark, d).drop("visibility").withColumns({
        "name": F.concat(F.lit("event "), F.when(n % 4 == 0, "Kit").otherwise("Tin")), "privacy": F.when(n % 11 == 0, "private").when(n % 11 == 1, "unlisted"),
        "join_url": F.when(n % 3 == 0, "x"), "has_private_place": n % 5 == 0, "override_level": F.when(n % 13 == 0, "public").when(n % 13 == 1, "held"), "override_hidden": n % 17 == 0,
    })
    rules = spark.createDataFrame([(1, "kit", None, "members", "crew"), (2, None, "music", "gated", None), (3, None, "food", "members", None)], "position int, title_contains string, category string, level string, audience string")
    return C.classify(C.first_rule(e, rules, "id"), "public").select("id", "visibility", "visibility_source", F.array_join("gated_fields", ",").alias("gated"))


@query(f"WITH {LEDGER} SELECT visibility, count(*) AS n FROM ledger WHERE visibility IN ('members', 'invite', 'held') AND id % 4 = 0 GROUP BY 1")
def leak_check(spark, d):
    e = ledger(spark, d).withColumn("public_uri", F.when(F.col("id") % 4 == 0, F.lit("at://x")))
    return C.leaks(e).groupBy("visibility").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') OR regexp_matches(text, '(?:\+?1[\s.-]?)?\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b') OR contains(text, 'ATTENDEE')""")
def privacy_audit(spark, d):
    return C.privacy_violations(table(spark, d, "documents"), F.col("text")).select("doc_id")


@query("""WITH m AS (SELECT c_custkey AS viewer, s_suppkey AS space, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 100 END AS role, c_custkey % 4 = 0 AS invited, c_custkey % 6 = 0 AS confirmed, c_custkey = s_suppkey AS authority
  FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT space, count(*) FILTER (confirmed OR authority OR role >= 20) AS gated, count(*) FILTER (role >= 100) AS managers, count(*) FILTER (invited OR role >= 10) AS invite FROM m GROUP BY 1""")
def access_matrix(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    k = F.col("c_custkey")
    m = c.join(s, c.c_nationkey == s.s_nationkey).select(
        F.col("s_suppkey").alias("space"), F.element_at(F.array(F.lit(10), F.lit(20), F.lit(100)), (k % 3 + 1).cast("int")).alias("role"),
        (k % 4 == 0).alias("invited"), F.lit(False).alias("shared"), (k % 6 == 0).alias("confirmed"), (k == F.col("s_suppkey")).alias("authority"),
    )
    return m.groupBy("space").agg(F.count_if(C.policy(C.GATED_DETAIL)).alias("gated"), F.count_if(C.policy(C.members(100))).alias("managers"), F.count_if(C.policy(C.INVITED)).alias("invite"))


@query("""WITH r AS (SELECT user_id AS invite, event_id % 40 AS person, min(ts) AS t FROM events GROUP BY ALL),
v AS (SELECT * FROM r WHERE invite % 9 <> 0 AND t < TIMESTAMP '2024-01-20')
SELECT invite, person, CAST(10 AS INTEGER) AS role, CAST(n AS INTEGER) AS used FROM (SELECT *, row_number() OVER (PARTITION BY invite ORDER BY t, person) AS n FROM v) WHERE n <= 5 + invite % 3""")
def redeem(spark, d):
    e = table(spark, d, "events")
    used = e.select(F.col("user_id").alias("invite"), (F.col("event_id") % 40).alias("person"), F.col("ts").alias("at"))
    i = F.col("invite")
    invites = e.select(F.col("user_id").alias("invite")).distinct().select("invite", (i % 9 == 0).alias("revoked"), F.lit("2024-01-20").cast("timestamp_ntz").alias("expires"), (i % 3 + 5).alias("max_uses"), F.lit(10).alias("role"))
    return C.redeem(used, invites)


@query(f"""WITH l AS (SELECT user_id % 10 AS space, user_id AS person, arg_max((CASE event_type WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'denied' ELSE 'pending' END, ts), (ts, event_id)) AS r FROM events GROUP BY ALL)
SELECT space, person, CASE WHEN struct_extract(r, 1) = 'pending' AND struct_extract(r, 2) < TIMESTAMP '2024-02-29' - INTERVAL 30 DAY THEN 'denied' ELSE struct_extract(r, 1) END AS state FROM l""")
def requests(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "signup", "approved").when(F.col("event_type") == "error", "denied").otherwise("pending")
    log = e.select((F.col("user_id") % 10).alias("space"), F.col("user_id").alias("person"), state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return C.request_states(log, F.lit("2024-02-29").cast("timestamp_ntz"))


# --- duplicates, search, venues --------------------------------------------------------------------

_ITEMS = f"""RECURSIVE items AS (SELECT p_partkey AS id, 'http://x/' || CASE WHEN p_partkey % 7 = 0 THEN p_partkey // 14 ELSE p_partkey END AS url, DATE '2024-01-01' + CAST(p_partkey % 3 AS INTEGER) AS day,
  {_TITLE % "p_name || ' & ' || p_type || ['', ' fair', ' fair one', ' fair one of two', ' No. ' || p_size][CAST(p_partkey % 5 + 1 AS INTEGER)]"} AS title, p_partkey AS starts_at FROM part),
f AS (SELECT url, arg_min((day, title, starts_at, id), (starts_at, id)) AS r FROM items GROUP BY 1),
u AS (SELECT url, struct_extract(r, 1) AS day, struct_extract(r, 2) AS title, struct_extract(r, 3) AS s, struct_extract(r, 4) AS i FROM f),
lead AS (SELECT day, title, min((s, i)) AS o FROM u GROUP BY ALL),
n AS (SELECT *, substr(title, 1, 13) AS head, row_number() OVER (PARTITION BY day, substr(title, 1, 13) ORDER BY o) AS nth FROM lead WHERE length(title) > 12),
w AS (SELECT day, head, nth, title, title AS opener, [title] AS openers FROM n WHERE nth = 1
  UNION ALL SELECT day, head, nth, title, coalesce(hit, title), CASE WHEN hit IS NULL THEN list_append(openers, title) ELSE openers END
  FROM (SELECT n.*, w.openers, list_filter(w.openers, lambda t: (starts_with(t, n.title) OR starts_with(n.title, t)) AND least(length(t), length(n.title)) >= 0.75 * greatest(length(t), length(n.title)))[1] AS hit
    FROM w JOIN n ON n.day = w.day AND n.head = w.head AND n.nth = w.nth + 1)),
named AS (SELECT lead.day, lead.title, struct_extract(first.o, 2) AS group_id, struct_extract(lead.o, 2) AS lead_id FROM lead LEFT JOIN w ON w.day = lead.day AND w.title = lead.title JOIN lead AS first ON first.day = lead.day AND first.title = coalesce(w.opener, lead.title)),
g AS (SELECT url, group_id FROM u JOIN named USING (day, title))"""


def _items(spark, d):
    n, c = F.col("p_partkey"), F.col
    more = F.get(F.array(F.lit(""), F.lit(" fair"), F.lit(" fair one"), F.lit(" fair one of two"), F.concat(F.lit(" No. "), "p_size")), (n % 5).cast("int"))
    return table(spark, d, "part").select(
        n.alias("id"), F.concat(F.lit("http://x/"), F.when(n % 7 == 0, F.floor(n / 14)).otherwise(n)).alias("url"), F.date_add(F.to_date(F.lit("2024-01-01")), (n % 3).cast("int")).alias("day"),
        T.norm_title(F.concat(c("p_name"), F.lit(" & "), c("p_type"), more)).alias("title"), n.alias("starts_at"), (n % 2).alias("rank"), n.alias("published_at"),
    )


@query(f"WITH {_ITEMS} SELECT id, group_id FROM items JOIN g USING (url)")
def dup_groups(spark, d):
    return G.groups(_items(spark, d))


@query(f"""WITH {_ITEMS}, a AS (SELECT group_id, id, url, row_number() OVER (PARTITION BY group_id ORDER BY id % 2, id) AS nth FROM items JOIN g USING (url))
SELECT group_id, max(CASE WHEN nth = 1 THEN id END) AS primary_id, count(*) AS n, count(DISTINCT url) - 1 AS also_on FROM a GROUP BY 1""")
def dup_collapse(spark, d):
    items = _items(spark, d)
    return G.collapse(items, G.groups(items))


@query(f"""WITH {_ITEMS} SELECT lead_id AS group_id, group_id AS into FROM named WHERE lead_id <> group_id""")
def dup_prefix(spark, d):
    return G.prefix_links(_items(spark, d))


@query(f"WITH {LEDGER} SELECT id FROM ledger WHERE {GUARD}")
def indexable(spark, d):
    return S.indexable(ledger(spark, d)).select("id")


@query(f"WITH {LEDGER} SELECT id FROM ledger WHERE NOT ({GUARD})")
def index_sweep(spark, d):
    everything = ledger(spark, d)
    return S.swept(everything, S.indexable(everything))


@query(f"""WITH c AS (SELECT user_id % 60 AS k, max(ts) AS fetched_at, max(value) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT event_id, CASE WHEN fetched_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY THEN c.value END AS value FROM events e LEFT JOIN c ON e.user_id = c.k""")
def geocode_cache(spark, d):
    e = table(spark, d, "events")
    cache = e.filter("user_id % 2 = 0").groupBy((F.col("user_id") % 60).alias("user_id")).agg(F.max("ts").alias("fetched_at"), F.max("value").alias("value"))
    return N.cached(e.select("event_id", "user_id"), cache, "user_id", F.lit("2024-01-31").cast("timestamp_ntz")).select("event_id", "value")


@query(f"WITH {LEDGER} SELECT count(*) AS kept FROM ledger WHERE starts_at >= {T0} - INTERVAL 10 DAY OR state <> 'removed'")
def retention(spark, d):
    e = ledger(spark, d)
    old = K.retained(e.filter("state = 'removed'"), F.col("starts_at"), now(), 10)
    return e.filter("state <> 'removed'").unionByName(old).agg(F.count("*").alias("kept"))


@query("""WITH l AS (SELECT user_id AS source, ts AS t, event_id AS seq, event_type <> 'error' AS ok, event_type = 'purchase' AS changed FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS fi, sum(CASE WHEN changed OR NOT ok THEN 1 ELSE 0 END) OVER w AS ui FROM l WINDOW w AS (PARTITION BY source ORDER BY t, seq)),
s AS (SELECT *, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY source, fi ORDER BY t, seq) AS failures, sum(CASE WHEN ok AND NOT changed THEN 1 ELSE 0 END) OVER (PARTITION BY source, ui ORDER BY t, seq) AS unchanged FROM i),
z AS (SELECT source, arg_max(failures, (t, seq)) AS failures, arg_max(unchanged, (t, seq)) AS unchanged, max(CASE WHEN ok THEN t END) AS good FROM s GROUP BY 1)
SELECT source, CASE WHEN good IS NULL OR good < TIMESTAMP '2024-02-10' - INTERVAL 14 DAY THEN 'paused' WHEN failures >= 3 THEN 'failing' ELSE 'ok' END AS status, CAST(failures AS BIGINT) AS failures, CAST(unchanged AS BIGINT) AS unchanged FROM z""")
def source_health(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "purchase").alias("changed"))
    return K.health(log, F.lit("2024-02-10").cast("timestamp_ntz"))
