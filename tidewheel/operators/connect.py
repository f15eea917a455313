"""Connecting sources: what an input is, who may connect it, and how far a host is trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source types whose rows are pushed, levels of trust, and domains that give handles to anyone.
PUSHED = ["upload", "manual", "api", "email", "extract"]
TRUST = {"listed": 0, "email": 1, "source": 2, "domain": 3}
SHARED_HANDLES = ["bsky.social", "bsky.team", "brid.gy", "threads.net", "mastodon.social"]
# Hosts and paths of platforms that are known, with the kind of source, the trust in it (0 to 1) and the platform's name.
# The first that matches both counts; several of one group are all offered.
PLATFORMS = [
    (r"(^|\.)google\.com$", r"/calendar/ical/[^/]+/(public|private-[a-f0-9]+)/(basic|full)\.ics|/calendar/(embed|u/\d+/embed|b/\d+/embed)\S*[?&]src=|[?&]cid=", "gcal-public", 0.97, "google"),
    (r"(^|\.)google\.com$", r"/calendar/?([?#]|$)|/calendar/u/\d+/?r?([?#]|$)", "gcal-public", 0.2, "google"),
    (r"(^|\.)docs\.google\.com$", r"^/spreadsheets/d/(e/)?[A-Za-z0-9_-]{10,}", "sheet", 0.95, "sheet"),
    (r"^(lu\.ma|luma\.com)$", r"^/(calendar|cal|cal-[^/?#]*)([/?#]|$)", "luma", 0.97, "luma"),
    (r"^(lu\.ma|luma\.com)$", r"^/(u|user)([/?#]|$)", "luma", 0.85, "luma"),
    (r"^(lu\.ma|luma\.com)$", r"^/[^/?#]", "luma", 0.9, "luma"),
    (r"^meetup\.com$", r"^/(?!(find|login|register|pro|home)([/?#]|$))[^/?#]", "meetup", 0.96, "meetup"),
    (r"(^|\.)eventbrite\.(com|co\.uk|ca|com\.au|de|fr|es|it|nl|ie)$", r"/o/[^/?#]", "jsonld-page", 0.6, "eventbrite"),
    (r"(^|\.)eventbrite\.(com|co\.uk|ca|com\.au|de|fr|es|it|nl|ie)$", "", "jsonld-page", 0.9, "eventbrite"),
    (r"(^|\.)(outlook\.(live|office)\.com|outlook\.office365\.com)$", r"(?i)\.ics$|/calendar/published/", "ics", 0.95, "outlook"),
    (r"(^|\.)icloud\.com$", r"(?i)/published/", "ics", 0.9, "icloud"),
    (r"(^|\.)tockify\.com$", "", "ics", 0.95, "tockify"),
    (r"(^|\.)teamup\.com$", "", "ics", 0.9, "teamup"),
    (r"(^|\.)trumba\.com$", "", "ics", 0.85, "trumba"),
    (r"(^|\.)libcal\.com$", "", "ics", 0.85, "libcal"),
    (r"(^|\.)localist\.com$", "", "localist", 0.9, "localist"),
    (r"(^|\.)mobilize\.us$", r"^/[^/?#]", "mobilize", 0.9, "mobilize"),
    (r"(^|\.)humanitix\.com$", "", "jsonld-page", 0.9, "humanitix"),
    (r"(^|\.)dandelion\.events$", "", "jsonld-page", 0.9, "dandelion"),
    (r"(^|\.)tickettailor\.com$", "", "jsonld-page", 0.85, "tickettailor"),
    (r"(^|\.)ti\.to$", "", "jsonld-page", 0.85, "tito"),
    (r"(^|\.)(facebook\.com|fb\.com|fb\.me)$", "", "extract", 0.0, "facebook"),
    (r"(^|\.)partiful\.com$", "", "extract", 0.0, "partiful"),
    ("", r"(?i)^[^?#]*\.ics([?#]|$)|format=ical|/ical/?$", "ics", 0.9, "ics"),
]
PROFILES = r"(^|\.)(bsky\.app|deer\.social|blacksky\.app)$"
DID = r"did:(?:plc:[a-z2-7]{24}|web:[A-Za-z0-9.:%-]+)"
HANDLE = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+"
HOSTING = ["eventbrite", "humanitix", "dandelion", "luma", "meetup", "tribe", "squarespace", "localist", "tockify", "libcal", "civicplus", "trumba", "teamup"]
SURE, ENOUGH = 0.85, 0.8


def first_url(text: Column) -> Column:
    """The first address in a pasted text, in embedding code, or a bare host; null without one."""
    bare = F.btrim(text)
    inside = F.regexp_extract(bare, "(?i)(?:src|href)=[\"']([^\"']+)[\"']", 1)
    open_ = F.regexp_extract(bare, "(?i)((?:https?|webcal)://[^\\s<>\"']+)", 1)
    host = F.when(bare.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(/\S*)?$"), F.concat(F.lit("https://"), bare))
    found = F.when(inside != "", inside).when(open_ != "", open_).otherwise(host)
    return F.regexp_replace(F.regexp_replace(found, "(?i)^webcal://", "https://"), "&amp;", "&")


def _first(cases) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda out, case: F.when(*case) if out is None else out.when(*case), cases, None)


def _match(kind: str, trust: Column | float, platform: Column | str, key: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), lit(trust).cast("double").alias("trust"), lit(platform).alias("platform"), key.alias("key"))


def classified(inputs: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, place, kind, platform, trust, key): what each pasted input (id, text) may be, best first, places from 1.

    An identity names a repository; a text without an address is read as words; an address of a platform that is known is what
    that platform gives; else its page (url, status, content_type, is_calendar, calendar_link, n_events, hints) decides: a calendar,
    links to one, linked data; a page with none of these, or none at all, is left to be read as words.  Pages that have the `id` of the input
    they were read for decide on that input alone; without it there is one page for each url.
    """
    bare = F.btrim(F.coalesce("text", F.lit("")))
    name = F.regexp_replace(bare, "^at://", "")
    actor = F.when(name.rlike(f"(?i)^{DID}$"), name).when(name.startswith("@") & F.lower(F.regexp_replace(name, "^@|/.*$", "")).rlike(f"^{HANDLE}$"), F.lower(F.regexp_replace(name, "^@|/.*$", "")))
    url = first_url(F.col("text"))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract("url", r"(?i)^https?://[^/?#]*(\S*)$", 1)
    rows = inputs.filter(bare != "").select("id", bare.alias("bare"), actor.alias("actor"), url.alias("url")).withColumns({"host": host, "path": F.when(path == "", "/").otherwise(path)})
    profile = F.col("host").rlike(PROFILES)
    who = F.regexp_extract("path", r"^/profile/([^/?#]+)", 1)
    who = F.when(profile & (who.rlike(f"(?i)^{DID}$") | F.lower(who).rlike(f"^{HANDLE}$")), F.when(who.rlike(f"(?i)^{DID}$"), who).otherwise(F.lower(who)))
    known = _first((F.col("host").rlike(on) & F.col("path").rlike(at), _match(*what, F.col("url"))) for on, at, *what in PLATFORMS)
    feed = _match("ics", 0.6, "localist", F.concat(F.regexp_extract("url", r"(?i)^(https?://[^/?#]+)", 1), F.lit("/calendar.ics")))
    rows = rows.withColumn("known", F.when(who.isNotNull(), _match("atproto", 0.95, "atproto", who)).when(~profile, known))
    rows = rows.withColumn("own", F.array_compact(F.array(F.col("known"), F.when(F.col("known.platform") == "localist", feed))))
    own = (F.col("url") == F.col("page_url")) & (F.col("id") == F.col("page_for") if "id" in pages.columns else F.lit(True))
    seen = rows.join(pages.withColumnsRenamed({"url": "page_url", "id": "page_for"}), own, "left")
    down = F.col("page_url").isNull() | (F.col("status") >= 400)
    calendar = F.coalesce(F.col("is_calendar") | F.contains("content_type", F.lit("text/calendar")), F.lit(False))
    data = F.contains(F.coalesce("content_type", F.lit("")), F.lit("json"))
    hosting = _first((F.array_contains("hints", p), F.lit("wordpress" if p == "tribe" else p)) for p in [*HOSTING, "wordpress"]).otherwise("web")
    prints = F.array_compact(F.array(F.when(F.col("calendar_link").isNotNull(), _match("ics", 0.9, "ics", F.col("calendar_link"))), F.when(F.col("n_events") > 0, _match("jsonld-page", 0.8, hosting, F.col("url")))))
    read = lambda trust: F.array(_match("extract", trust, "web", F.col("url")))
    enough = F.exists(F.concat("own", prints), lambda m: m.trust >= ENOUGH)
    found = (
        F.when(F.col("actor").isNotNull(), F.array(_match("atproto", 0.95, "atproto", F.col("actor"))))
        .when(F.col("url").isNull(), F.array(_match("extract", 0.7, "text", F.lit(None).cast("string"))))
        .when(F.exists("own", lambda m: m.trust >= SURE), F.col("own"))
        .when(down, F.when(F.size("own") > 0, F.col("own")).otherwise(read(0.0)))
        .when(calendar, F.concat("own", F.array(_match("ics", 0.98, "ics", F.col("url")))))
        .when(data, F.concat("own", read(0.1)))
        .when(enough, F.concat("own", prints)).otherwise(F.concat("own", prints, read(0.3)))
    )
    each = seen.select("id", F.posexplode(found).alias("given", "m")).select("id", "given", "m.*")
    best = each.groupBy("id", "kind", "platform", "key").agg(F.max(F.struct("trust", -F.col("given"))).alias("b"))  # an input has a few matches at most
    ranked = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("b", "kind", "platform", "key")), asc=False).alias("all"))
    return ranked.select("id", F.posexplode("all").alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), "x.kind", "x.platform", F.col("x.b.trust").alias("trust"), "x.key")


def connected(asks: DataFrame, blocked: DataFrame, sources: DataFrame) -> DataFrame:
    """(ask, outcome) for hosts that ask for sources (ask, host, fingerprint): blocked, taken (by another host), mine, or created for the first ask."""
    b = blocked.select("fingerprint").distinct().withColumn("no", F.lit(True))
    own = sources.groupBy("fingerprint").agg(F.min("host").alias("owner"))
    first = asks.join(b, "fingerprint", "left_anti").join(own, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min(F.struct("ask", "host")).alias("f"))
    rows = asks.join(b, "fingerprint", "left").join(own, "fingerprint", "left").join(first, "fingerprint", "left")
    owner = F.coalesce("owner", "f.host")
    outcome = F.when(F.col("no"), "blocked").when(F.col("ask") == F.col("f.ask"), "created").when(owner == F.col("host"), "mine").otherwise("taken")
    return rows.select("ask", outcome.alias("outcome"))


def managed(roles: DataFrame, hosts: DataFrame) -> DataFrame:
    """(person, host, handle, role): the hosts, other than oneself, that a person may act for; roles: person, host, role; hosts: host, handle, did."""
    return roles.join(hosts.select("host", "handle", "did"), "host").filter("person <> did").select("person", "host", "handle", "role")


def own_uri(kind: Column, source_did: Column, host_did: Column, collection: Column, external_id: Column) -> Column:
    """The address of the record that an event of a host's own repository already is; else null."""
    where = F.coalesce(F.nullif(collection, F.lit("")), F.lit("community.lexicon.calendar.event"))
    return F.when((kind == "atproto") & (source_did == host_did), F.concat(F.lit("at://"), source_did, F.lit("/"), where, F.lit("/"), external_id))


def verified(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, verified, reason): whether a source's token stands in its title, its description or its rows' texts.

    sources: source, kind, token, title, description; rows: source, name, description, location.
    """
    token = F.lower(F.col("token"))
    poll = sources.filter(~F.col("kind").isin(*PUSHED) & (F.coalesce("token", F.lit("")) != ""))
    texts = rows.select("source", F.lower(F.concat_ws("\n", "name", "description", "location")).alias("said"))
    hit = texts.join(poll.select("source", token.alias("want")), "source").filter(F.contains("said", F.col("want"))).select("source").distinct().withColumn("hit", F.lit(True))
    own = F.contains(F.lower(F.concat_ws("\n", "title", sources["description"])), token)
    ok = F.col("kind").isin(*PUSHED), F.coalesce("token", F.lit("")) == ""
    found = F.coalesce("hit", F.lit(False)) | F.coalesce(own, F.lit(False))
    reason = F.when(ok[1], "no token").when(ok[0], "pushed").when(~found, "not found")
    return sources.join(hit, "source", "left").select("source", reason.isNull().alias("verified"), reason.alias("reason"))


def is_own_domain(handle: Column, handle_domain: str) -> Column:
    """Whether a handle is a domain of its host's own, not one that this service or a large provider gives."""
    h = F.lower(handle)
    shared = reduce(lambda a, d: a | (h == d) | h.endswith(f".{d}"), SHARED_HANDLES, h.endswith(f".{handle_domain}"))
    return ~shared & (F.size(F.split(h, r"\.")) <= 3) & ~h.startswith("did:")


def trust_rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair)), level), F.lit(0))


def raised(hosts: DataFrame, proofs: DataFrame) -> DataFrame:
    """hosts (host, level) with the highest level that a proof (host, level) shows, if it is above their own, and whether it rose."""
    best = proofs.groupBy("host").agg(F.max_by("level", trust_rank(F.col("level"))).alias("proof"))
    up = F.coalesce(trust_rank(F.col("proof")) > trust_rank(F.coalesce("level", F.lit("email"))), F.lit(False))
    return hosts.join(best, "host", "left").select("host", F.when(up, F.col("proof")).otherwise(F.coalesce("level", F.lit("email"))).alias("level"), up.alias("rose"))


def routed(sources: DataFrame, pushed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of this run: of sources (source, kind) whose rows are pushed those that are kept, of the others those just fetched."""
    by = sources.select("source", F.col("kind").isin(*PUSHED).alias("push"))
    mine = pushed.join(by.filter("push").select("source"), "source", "left_semi")
    return mine.unionByName(fetched.join(by.filter("not push").select("source"), "source", "left_semi"))
