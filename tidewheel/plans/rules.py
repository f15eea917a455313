"""Queries of hosts' rules over all their conditions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from .catalog import query
from .views import LEDGER, LEVELS, NAMES, ledger, table

# A rule for each order, of one host in 25 by its customer; an event's source is mapped to a space for one host in three.
_RULES = f"""{LEDGER}, r AS (SELECT o_orderkey AS position, o_custkey % 25 AS host,
    CASE o_orderkey % 8 WHEN 0 THEN 'NIGHT ' || o_orderkey % 97 WHEN 1 THEN 'ght ' || o_orderkey % 89 || ' ' WHEN 5 THEN 'Tin' WHEN 6 THEN o_orderkey % 10 || ' ' END AS title,
    CASE WHEN o_orderkey % 8 IN (1, 2, 6) THEN 'CAL ' || o_orderkey % 7 WHEN o_orderkey % 8 = 3 THEN '' END AS calendar,
    CASE WHEN o_orderkey % 8 IN (3, 5) THEN {NAMES}[CAST(o_orderkey % 10 + 1 AS INTEGER)] WHEN o_orderkey % 64 = 4 THEN 'Music' END AS category,
    CASE WHEN o_orderkey % 8 IN (2, 4, 5) THEN ['home', 'venue', 'online'][CAST(o_orderkey % 3 + 1 AS INTEGER)] END AS place,
    CASE WHEN o_orderkey % 8 IN (2, 3, 4, 7) THEN ['private', 'membersOnly', 'conference'][CAST(o_orderkey // 8 % 3 + 1 AS INTEGER)] END AS flag,
    {LEVELS}[CAST(o_orderkey // 3 % 6 + 1 AS INTEGER)] AS level, CASE WHEN o_orderkey % 3 = 0 THEN 'crew ' || o_orderkey % 5 END AS audience,
    CASE o_orderkey % 4 WHEN 0 THEN ['description', 'joinUrl'] WHEN 1 THEN ['attendees'] END AS fields FROM orders),
e AS (SELECT *, CASE id % 4 WHEN 0 THEN 'Kit' ELSE 'Tin' END || ' Night ' || id % 97 || ' of ' || category AS name, CASE WHEN id % 9 <> 0 THEN 'Cal ' || source % 7 END AS calendar,
    CASE id % 11 WHEN 0 THEN 'private' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'confidential' END AS privacy, CASE WHEN id % 3 = 0 THEN 'x' END AS join_url, id % 5 = 0 AS home, id % 6 = 1 AS online,
    CASE id % 13 WHEN 0 THEN 'public' WHEN 1 THEN 'held' WHEN 2 THEN 'invite' END AS o, CASE WHEN id % 26 < 13 THEN 'own' END AS oa, CASE WHEN id % 2 = 0 THEN ['exactLocation', 'description'] END AS ofields, id % 17 = 0 AS h,
    {LEVELS}[CAST(host % 5 + 1 AS INTEGER)] AS base, CASE WHEN host % 2 = 0 THEN 'space ' || host END AS own, host % 3 = 0 AS mapped FROM ledger)"""
_MET = """r.host = e.host AND (coalesce(r.title, '') = '' OR contains(lower(e.name), lower(r.title))) AND (coalesce(r.calendar, '') = '' OR lower(coalesce(e.calendar, '')) = lower(r.calendar))
  AND (coalesce(r.category, '') = '' OR coalesce(e.category, '') = r.category OR list_contains(e.tags, lower(r.category)))
  AND (r.place IS NULL OR CASE WHEN e.online THEN 'online' WHEN e.home THEN 'home' ELSE 'venue' END = r.place)
  AND (r.flag IS DISTINCT FROM 'private' OR coalesce(e.privacy IN ('private', 'confidential'), false)) AND (r.flag IS DISTINCT FROM 'membersOnly' OR coalesce(e.privacy = 'unlisted', false)) AND (r.flag IS DISTINCT FROM 'conference' OR e.join_url IS NOT NULL)"""
_RANKS = "MAP {'public': 5, 'unlisted': 4, 'gated': 3, 'members': 2, 'invite': 1, 'held': 0}"


def _tables(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    kind = n % 8
    rules = o.select(
        n.alias("position"), (F.col("o_custkey") % 25).alias("host"),
        F.when(kind == 0, say("NIGHT ", n % 97)).when(kind == 1, say("ght ", n % 89, " ")).when(kind == 5, "Tin").when(kind == 6, say(n % 10, " ")).alias("title_contains"),
        F.when(kind.isin(1, 2, 6), say("CAL ", n % 7)).when(kind == 3, "").alias("calendar"), F.when(kind.isin(3, 5), pick(NAMES, n % 10)).when(n % 64 == 4, "Music").alias("category"),
        F.when(kind.isin(2, 4, 5), pick(["home", "venue", "online"], n % 3)).alias("location_type"), F.when(kind.isin(2, 3, 4, 7), pick(["private", "membersOnly", "conference"], F.floor(n / 8) % 3)).alias("flag"),
        pick(LEVELS, F.floor(n / 3) % 6).alias("level"), F.when(n % 3 == 0, say("crew ", n % 5)).alias("audience"),
        F.when(n % 4 == 0, F.array(F.lit("description"), F.lit("joinUrl"))).when(n % 4 == 1, F.array(F.lit("attendees"))).alias("gated_fields"),
    )
    i, join_url = F.col("id"), F.when(F.col("id") % 3 == 0, "x")
    privacy = F.when(i % 11 == 0, "private").when(i % 11 == 1, "unlisted").when(i % 11 == 2, "confidential")
    events = ledger(spark, d).drop("visibility").withColumns({
        "name": say(F.when(i % 4 == 0, "Kit").otherwise("Tin"), " Night ", i % 97, " of ", F.col("category")), "calendar": F.when(i % 9 != 0, say("Cal ", F.col("source") % 7)), "privacy": privacy, "join_url": join_url,
        "has_private_place": i % 5 == 0, "place_type": C.place_type(F.when(i % 6 == 1, "virtual"), i % 5 == 0), "flags": C.flags(privacy, join_url),
        "override_level": F.when(i % 13 == 0, "public").when(i % 13 == 1, "held").when(i % 13 == 2, "invite"), "override_audience": F.when(i % 26 < 13, "own"),
        "override_fields": F.when(i % 2 == 0, F.array(F.lit("exactLocation"), F.lit("description"))), "override_hidden": i % 17 == 0,
        "default_level": pick(LEVELS, F.col("host") % 5), "default_audience": F.when(F.col("host") % 2 == 0, say("space ", F.col("host"))), "in_space": F.col("host") % 3 == 0,
    })
    return events, rules


@query(f"WITH {_RULES} SELECT e.id, min(r.position) AS rule FROM e JOIN r ON {_MET} GROUP BY 1")
def matched_rules(spark, d):
    events, rules = _tables(spark, d)
    return C.first_rule(events, rules, "id").filter("rule_position is not null").select("id", F.col("rule_position").alias("rule"))


@query(f"""WITH {_RULES}, b AS (SELECT e.id, arg_min({{'level': r.level, 'audience': r.audience, 'fields': r.fields}}, r.position) AS rule FROM e JOIN r ON {_MET} GROUP BY 1),
c AS (SELECT e.*, rule.level AS rl, rule.audience AS ra, rule.fields AS rf, coalesce(rule.level, base) AS start,
  CASE WHEN privacy IN ('private', 'confidential') THEN CASE WHEN mapped AND own IS NOT NULL AND base IN ('members', 'invite') THEN base ELSE 'held' END WHEN privacy = 'unlisted' THEN 'unlisted' END AS cap FROM e LEFT JOIN b USING (id)),
k AS (SELECT *, coalesce({_RANKS}[cap] < {_RANKS}[start], false) AS capped, o IS NOT NULL AND NOT coalesce({_RANKS}[o] > {_RANKS}[cap], false) AS chosen FROM c),
m AS (SELECT *, CASE WHEN h THEN 'held' WHEN chosen THEN o WHEN capped THEN cap ELSE start END AS level, CASE WHEN h OR chosen THEN 'per-event' WHEN capped THEN 'source-signal' WHEN rl IS NOT NULL THEN 'rule' ELSE 'host-default' END AS visibility_source,
  coalesce(CASE WHEN o IS NOT NULL THEN oa END, ra, own) AS aud,
  list_concat(CASE WHEN join_url IS NOT NULL THEN ['joinUrl'] ELSE [] END, CASE WHEN home THEN ['exactLocation'] ELSE [] END, coalesce(rf, []), CASE WHEN o IS NOT NULL THEN coalesce(ofields, []) ELSE [] END) AS fields FROM k)
SELECT id, CASE WHEN level IN ('members', 'invite') AND aud IS NULL THEN 'held' ELSE level END AS visibility, visibility_source, CASE WHEN level IN ('members', 'invite') THEN aud END AS audience,
  array_to_string(list_sort(CASE WHEN level = 'gated' AND len(fields) = 0 THEN ['exactLocation'] ELSE list_distinct(fields) END), ',') AS gated FROM m""")
def classify_by_rules(spark, d):
    events, rules = _tables(spark, d)
    out = C.classify(C.first_rule(events, rules, "id"), F.col("default_level"), F.col("default_audience"), F.col("in_space"))
    return out.select("id", "visibility", "visibility_source", "audience", F.array_join(F.array_sort("gated_fields"), ",").alias("gated"))
