"""Column functions on addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, conference hosts, the link pattern and the text that replaces a link.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "_hsenc", "_hsmi", "igshid"]
CONFERENCE = r"(?i)^https?://(?:[^/?#]*\.)?(zoom\.us|zoom\.com|meet\.google\.com|teams\.microsoft\.com|teams\.live\.com|meet\.jit\.si|whereby\.com|gather\.town|webex\.com|bluejeans\.com|gotomeeting\.com|streamyard\.com)(?:[:/?#]|$)"
NOT_A_CALL = r"(?i)^https?://[^/?#]*/(?:pricing|about|download)"
LINK = r"https?://[^\s<>()\]\"']+[^\s<>()\]\"'.,;:!?]"
SHARED_LATER = "[link shared with confirmed guests]"


def canonical(url: Column) -> Column:
    """https or http, lower-case host without www., no tracking parameters, fragment or last slash; else null."""
    whole = F.regexp_replace(F.btrim(url), r"(?i)^webcal://", "https://")
    part = lambda i: F.regexp_extract(whole, r"^(?i:(https?))://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#.*)?$", i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    args = F.filter(F.split(part(4), "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & (p != ""))
    query = F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise("")
    path = F.when((part(3) == "/") & (query == ""), "").otherwise(part(3))
    joined = F.concat(F.lower(part(1)), F.lit("://"), host, path, query)
    return F.when(part(1) != "", F.when((part(3) != "/"), F.regexp_replace(joined, "/$", "")).otherwise(joined))


def domain(url: Column) -> Column:
    return F.regexp_extract(canonical(url), r"^https?://([^/?#]+)", 1)


def links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)))


def is_conference(url: Column) -> Column:
    return url.rlike(CONFERENCE) & ~url.rlike(NOT_A_CALL)


def scrub(text: Column) -> Column:
    """struct(join_url, text): the first conference link, and the text with every one replaced."""
    found = F.filter(links(text), is_conference)
    return F.struct(
        F.get(found, F.lit(0)).alias("join_url"),
        F.aggregate(found, text, lambda t, u: F.replace(t, u, F.lit(SHARED_LATER))).alias("text"),
    )


def facets(text: Column) -> Column:
    """array<struct(start, end, uri)>: UTF-8 byte offsets of every link."""
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    gaps = F.split(text, LINK)
    step = lambda a, i: F.struct(
        (a.at + F.octet_length(F.get(gaps, i)) + F.octet_length(F.get(found, i))).alias("at"),
        F.concat(a.out, F.array(F.struct(
            (a.at + F.octet_length(F.get(gaps, i))).alias("start"),
            (a.at + F.octet_length(F.get(gaps, i)) + F.octet_length(F.get(found, i))).alias("end"), F.get(found, i).alias("uri")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,uri:string>>").alias("out"))
    return F.when(F.size(found) == 0, start.out).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), start, step, lambda a: a.out)
    )
