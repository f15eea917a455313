"""Queries of hand-made changes, exports, previews, rewritten feeds, records and delta reads, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import account as A
from ..operators import confirm as Q
from ..operators import upkeep as K
from ..sources import delta, records, rewrite
from .catalog import query
from .views import LEDGER, LEVELS, NOW, ledger, now, table

_RANK = "CASE %s WHEN 'public' THEN 5 WHEN 'unlisted' THEN 4 WHEN 'gated' THEN 3 WHEN 'members' THEN 2 WHEN 'invite' THEN 1 ELSE 0 END"


def _to(n):
    """The level that a patch of event n asks for."""
    return F.get(F.array(*map(F.lit, LEVELS)), ((n * 5 + 1) % 6).cast("int"))


_PATCHED = f"""WITH {LEDGER}, p AS (SELECT id, source, visibility, CASE WHEN id % 4 <> 3 THEN {LEVELS}[CAST((id * 5 + 1) % 6 + 1 AS INTEGER)] END AS ask, id % 7 = 0 AS clear FROM ledger),
x AS (SELECT *, coalesce({_RANK % 'ask'} > {_RANK % 'visibility'} AND ask IS NOT NULL, false) AS wider FROM p)"""


def _patched(spark, d):
    e, n, none = ledger(spark, d), F.col("id"), F.lit(None).cast("string")
    override = F.struct(F.lit(False).alias("hidden"), none.alias("category"), F.lit("i").alias("image"), F.array(F.lit("joinUrl")).alias("gated_fields"), none.alias("audience"), F.lit("held").alias("level"), F.lit("public").alias("allow_widen_to"))
    patches = e.select("id", (n % 2 == 0).alias("hidden"), F.when(n % 3 == 0, "arts").alias("category"), none.alias("image"), F.lit(None).cast("array<string>").alias("gated_fields"), none.alias("audience"),
                       (n % 7 == 0).alias("clear_image"), F.when(n % 4 != 3, _to(n)).alias("visibility"))
    return Q.patch(e.select("id", "source", "visibility", override.alias("override")), patches, now())


@query(_PATCHED + """ SELECT id, id % 2 = 0 AS hidden, CASE WHEN id % 3 = 0 THEN 'arts' END AS category, CASE WHEN NOT clear THEN 'i' END AS image,
CASE WHEN ask IS NOT NULL AND NOT wider THEN ask ELSE 'held' END AS level, CASE WHEN ask IS NULL OR wider THEN 'public' END AS allow_widen_to FROM x""")
def override_patch(spark, d):
    return _patched(spark, d)[0].select("id", *(f"override.{c}" for c in ("hidden", "category", "image", "level", "allow_widen_to")))


@query(_PATCHED + f""" SELECT id, source, visibility AS "from", ask AS "to", TIMESTAMP '{NOW}' + INTERVAL 30 DAY AS expires_at FROM x WHERE wider""")
def override_queue(spark, d):
    return _patched(spark, d)[1].drop("kind")


def _resolved(spark, d):
    """One decision for each event; every seventh item is gone, every fifth resolved, a third are of extracted rows."""
    e, n = table(spark, d, "events"), F.col("event_id")
    row = lambda suffix, name: F.struct(F.concat(n.cast("string"), F.lit(suffix)).alias("external_id"), name.alias("name"), F.lit("2024-02-01").alias("start"))
    items = e.filter(n % 7 != 0).select(
        n.alias("item"), (F.col("user_id") % 25).alias("host"), F.when(n % 3 == 0, "extracted").otherwise("widen").alias("kind"), F.when(n % 3 == 0, F.array(row("a", F.col("event_type")), row("b", F.lit(" ")))).alias("extracted"),
        n.alias("event"), F.lit("public").alias("to"), F.when(n % 4 == 0, "public").alias("source_default"), F.when(n % 5 == 0, F.col("ts")).alias("resolved_at"))
    decisions = e.select(n.alias("item"), (F.col("user_id") % 25).alias("host"), F.when(n % 2 == 0, "confirm").otherwise("reject").alias("action"))
    edits = e.filter(n % 9 == 0).select(n.alias("item"), F.concat(n.cast("string"), F.lit("b")).alias("external_id"), F.lit("Named").alias("name"))
    return Q.outcomes(decisions, items), edits


@query("SELECT event_id AS item, CASE WHEN event_id % 7 = 0 THEN 'not-found' WHEN event_id % 5 = 0 THEN 'already-resolved' WHEN event_id % 2 = 1 THEN 'rejected' ELSE 'confirmed' END AS outcome FROM events")
def confirm_outcomes(spark, d):
    return _resolved(spark, d)[0].select("item", "outcome")


_CONFIRMED = "event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 2 = 0"


@query(f"""SELECT event_id AS item, event_id || 'a' AS external_id, event_type AS name, '2024-02-01' AS start FROM events WHERE {_CONFIRMED} AND event_id % 3 = 0
UNION ALL SELECT event_id, event_id || 'b', 'Named', '2024-02-01' FROM events WHERE {_CONFIRMED} AND event_id % 9 = 0""")
def confirm_extracted(spark, d):
    return Q.extracted(*_resolved(spark, d)).drop("host")


@query(f"SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN 'public' ELSE 'held' END AS level, 'public' AS allow_widen_to FROM events WHERE {_CONFIRMED} AND event_id % 3 <> 0")
def confirm_widened(spark, d):
    e = ledger(spark, d).select("id", "host", F.struct(F.lit("held").alias("level")).alias("override"))
    return Q.widened(_resolved(spark, d)[0], e)


@query(f"WITH {LEDGER} SELECT host, id, state, host * 3 AS source FROM ledger WHERE host IN (SELECT host FROM host)")
def account_export(spark, d):
    """The documents of all hosts, read back: each event once, with the host's one source from part 0."""
    n = table(spark, d, "nation")
    hosts = n.select(F.col("n_nationkey").cast("long").alias("host"), F.col("n_name").alias("name"))
    sources = hosts.select("host", (F.col("host") * 3).alias("source"))
    out = A.account_export(hosts, sources, sources.select("source", F.lit("public").alias("level")), ledger(spark, d).select("host", "id", "state", "visibility"))
    read = out.select("host", "part", F.from_json("body", "sources array<struct<source long>>, rules array<struct<source long>>, events array<struct<id long, state string>>").alias("b"))
    heads = read.filter("part = 0").select("host", F.get("b.sources", F.lit(0))["source"].alias("source"))
    return read.select("host", F.explode("b.events").alias("e")).join(heads, "host").select("host", "e.id", "e.state", "source")


@query(f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY starts_at, id) AS k FROM ledger), s AS (SELECT *, coalesce(ends_at, starts_at) >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS ahead FROM r WHERE k <= 500)
SELECT source, count(*) FILTER (WHERE id % 11 <> 0) AS count, count(*) FILTER (WHERE id % 11 = 0) AS dropped, count(*) FILTER (WHERE id % 11 <> 0 AND ahead) AS upcoming, count(*) FILTER (WHERE id % 11 <> 0 AND visibility = 'held') AS private,
count(*) FILTER (WHERE id % 11 <> 0 AND id % 13 = 0) AS links, count(*) FILTER (WHERE id % 11 <> 0 AND ahead AND NOT has_image) AS no_image,
coalesce(array_to_string((list(CAST(id AS VARCHAR) ORDER BY k) FILTER (WHERE id % 11 <> 0 AND ahead))[1:60], ','), '') AS cards FROM s GROUP BY 1""")
def source_preview(spark, d):
    n = F.col("id")
    rows = ledger(spark, d).select(
        "source", F.col("starts_at").alias("position"), "id", (n % 11 != 0).alias("readable"), "starts_at", "ends_at", F.when(F.col("visibility") == "held", "private").alias("privacy"),
        F.when(n % 13 == 0, "j").alias("join_url"), F.when(F.col("has_image"), "i").alias("image"), F.lit(False).alias("tz_inferred"))
    return A.preview(rows, now()).select("source", "count", "dropped", "upcoming", "private", "links", "no_image", F.array_join(F.transform("cards", lambda x: x.cast("string")), ",").alias("cards"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def cache_fresh(spark, d):
    return K.fresh(table(spark, d, "events"), "page", F.col("ts"), F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://lu.ma/abc' || 1000 + event_id WHEN 1 THEN 'https://lu.ma/p' || event_id WHEN 2 THEN 'https://lu.ma/evt-' || event_id ELSE 'https://x.org/' || event_id END AS url,
CASE WHEN event_id % 4 = 2 THEN NULL ELSE 'https://x.org/' END AS other FROM events""")
def feed_rewrite(spark, d):
    """Short addresses by description, host and id; and group pages where an id names an event."""
    e, n = table(spark, d, "events"), F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("See https://luma.com/abc"), (F.col("event_id") + 1000).cast("string"), F.lit(" now"))).when(k == 1, "https://lu.ma/event12")
    url = F.when(k == 1, F.concat(F.lit("https://www.luma.com/p"), n)).when(k == 3, F.concat(F.lit("https://x.org/"), n))
    rows = e.select("event_id", text.alias("description"), url.alias("url"), F.concat(F.when(k == 3, "x-").otherwise("evt-"), n, F.lit("@e")).alias("external_id"))
    other = rewrite.meetup(e.select("event_id", F.when(k != 2, "https://x.org/").alias("url"), F.lit("x").alias("external_id")), F.lit("g")).select("event_id", F.col("url").alias("other"))
    return rewrite.luma(rows).select("event_id", "url").join(other, "event_id")


@query("""SELECT 'k' || event_id AS external_id, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'virtual' WHEN 1 THEN 'inperson' END AS mode, CASE WHEN event_id % 2 = 0 THEN 'unlisted' END AS privacy, 'https://x.org/' || event_id AS url,
CASE WHEN event_id % 4 = 0 THEN 'Hall' ELSE 'Town' END AS place, CASE WHEN event_id % 4 = 0 THEN CAST(40.5 AS DOUBLE) END AS lat, 'https://h/xrpc/com.atproto.sync.getBlob?did=did%3Ax&cid=c2' AS image FROM events WHERE event_id % 5 <> 0""")
def repository_records(spark, d):
    e = table(spark, d, "events")
    text = F.expr("""to_json(named_struct('name', event_type, 'startsAt', cast(ts as string), 'mode', case event_id % 3 when 0 then 'a.b#virtual' when 1 then 'InPerson' else 'a#odd' end,
        'preferences', named_struct('showInDiscovery', event_id % 2 <> 0), 'uris', array(named_struct('uri', 'mailto:x'), named_struct('uri', concat('https://x.org/', event_id))),
        'locations', if(event_id % 4 = 0, array(named_struct('$type', 'l.location.geo', 'name', 'Hall', 'latitude', '40.5', 'longitude', '-105.0', 'locality', cast(null as string)),
            named_struct('$type', 'l.location.address', 'name', cast(null as string), 'latitude', cast(null as string), 'longitude', cast(null as string), 'locality', 'Lyons')),
            array(named_struct('$type', 'l.location.hthree', 'name', 'Town', 'latitude', cast(null as string), 'longitude', cast(null as string), 'locality', cast(null as string)))),
        'media', array(named_struct('role', 'banner', 'content', named_struct('ref', named_struct('$link', 'c1'))), named_struct('role', 'thumbnail', 'content', named_struct('ref', named_struct('$link', 'c2')))),
        'additionalData', named_struct('externalSource', if(event_id % 5 = 0, named_struct('id', 'x'), null))))""")
    rows = e.select(F.concat(F.lit("at://x/c/k"), F.col("event_id").cast("string")).alias("uri"), F.lit("did:x").alias("did"), F.lit("https://h").alias("host"), text.alias("record"))
    at = F.get("locations", F.lit(0))
    return records.read(rows).select("external_id", "name", "mode", "privacy", "url", at["name"].alias("place"), at["lat"].alias("lat"), "image")


_ANSWERS = """p AS (SELECT user_id AS source, event_id AS page, CASE WHEN user_id % 3 = 1 OR user_id % 3 = 2 AND event_id % 5 IN (0, 3, 4) THEN 't' || user_id END AS token, CASE WHEN user_id % 3 = 2 AND event_id % 5 = 0 THEN 410 ELSE 200 END AS status FROM events),
f AS (SELECT source, bool_or(status = 410) AS expired, max(token) AS old FROM p GROUP BY 1)"""


def _answers(spark, d):
    """Each event as an answer to its user's source: a third without tokens, a third with, a third whose tokens expire."""
    k, m = F.col("user_id") % 3, F.col("event_id") % 5
    body = F.expr("to_json(named_struct('items', array(named_struct('id', cast(event_id as string), 'summary', event_type, 'start', named_struct('date', '2024-02-01')))))")
    old = F.when((k == 1) | ((k == 2) & m.isin(0, 3, 4)), F.concat(F.lit("t"), F.col("user_id").cast("string")))
    return delta.google(table(spark, d, "events").select(F.col("user_id").alias("source"), F.lit(0).alias("fetch"), F.col("event_id").alias("page"), old.alias("token"), F.when((k == 2) & (m == 0), 410).otherwise(200).alias("status"), body.alias("payload")))


@query(f"WITH {_ANSWERS} SELECT source, CAST(page AS VARCHAR) AS external_id, expired OR old IS NULL AS complete FROM p JOIN f USING (source) WHERE status = 200 AND (NOT expired OR token IS NULL)")
def delta_rows(spark, d):
    return _answers(spark, d)[0].select("source", "external_id", "complete")


@query(f"WITH {_ANSWERS} SELECT source, expired OR old IS NULL AS complete, old AS cursor FROM f")
def delta_fetches(spark, d):
    return _answers(spark, d)[1].select("source", "complete", "cursor")
