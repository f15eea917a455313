"""Calendar export: one block of lines for each event, and bodies of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST, FOLD, DESCRIPTION = 74, 73, 2000


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(out, "([;,])", r"\\$1"), r"\r?\n", r"\\n")


def fold(line: Column) -> Column:
    """Lines over LONGEST in pieces of FOLD characters, the further ones after a space."""
    return F.when(F.length(line) > LONGEST, F.regexp_replace(line, f"(?s)(.{{{FOLD}}})(?=.)", "$1\r\n ")).otherwise(line)


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def event_block(zone: str) -> Column:
    """The lines of an event (uid, fetched_at, name, starts_at, ends_at, all_day, venue, street, locality, region, lat, lon,
    exact, visibility, url, category, tags, description, status), folded and joined by CRLF."""
    line = lambda name, v: F.concat(F.lit(name + ":"), v)
    local = lambda c: F.to_date(F.from_utc_timestamp(F.col(c).cast("timestamp"), zone))
    day, last = local("starts_at"), F.coalesce(local("ends_at"), local("starts_at"))
    after = F.when(last > day, last).otherwise(F.date_add(day, 1))
    timed = ~F.coalesce("all_day", F.lit(False))
    gated = F.coalesce(F.col("visibility") == "gated", F.lit(False))
    place = F.when(gated, F.concat_ws(", ", "locality", "region")).otherwise(F.concat_ws(", ", "venue", "street", "locality", "region"))
    words = F.concat_ws(",", F.array("category"), "tags")
    lines = F.array(
        F.lit("BEGIN:VEVENT"), line("UID", F.col("uid")), line("DTSTAMP", stamp(F.col("fetched_at"))),
        F.when(timed, line("DTSTART", stamp(F.col("starts_at")))).otherwise(line("DTSTART;VALUE=DATE", F.date_format(day, "yyyyMMdd"))),
        F.when(timed, line("DTEND", stamp(F.col("ends_at")))).otherwise(line("DTEND;VALUE=DATE", F.date_format(after, "yyyyMMdd"))),
        line("SUMMARY", escape(F.col("name"))), F.when(place != "", line("LOCATION", escape(place))),
        F.when(~gated & F.col("exact"), line("GEO", F.concat_ws(";", F.when(F.col("lon").isNotNull(), F.col("lat")), F.when(F.col("lat").isNotNull(), F.col("lon"))))),
        line("URL", F.col("url")), F.when(words != "", line("CATEGORIES", escape(words))),
        line("DESCRIPTION", escape(F.substring("description", 1, DESCRIPTION))), F.when(F.col("status") == "cancelled", "STATUS:CANCELLED"), F.lit("END:VEVENT"),
    )
    return F.array_join(F.transform(F.filter(lines, lambda s: s.isNotNull() & (s != "GEO:")), fold), "\r\n")


def header(name: Column, producer: str) -> Column:
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:-//{producer}//EN"), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"),
        F.concat(F.lit("X-WR-CALNAME:"), escape(name)), F.concat(F.lit("NAME:"), escape(name)), F.lit("REFRESH-INTERVAL;VALUE=DURATION:PT2H"), F.lit("X-PUBLISHED-TTL:PT2H"),
    ]
    return F.array_join(F.transform(F.array(*lines), fold), "\r\n")


def select(events: DataFrame, by: str, now: Column, days: int | None, most: int) -> DataFrame:
    """The next `most` rows of each group from a day before now, by start; `days` ahead if given."""
    shown = F.col("state").isin("live", "cancelled") & F.col("visibility").isin("public", "gated") & (F.col("starts_at") >= now - F.expr("interval 1 day"))
    if days is not None:
        shown &= F.col("starts_at") <= now + F.expr(f"interval {days} days")
    rank = F.row_number().over(W.partitionBy(by).orderBy("starts_at", "id"))
    return events.filter(shown).withColumn("rank", rank).filter(F.col("rank") <= most)


def calendars(events: DataFrame, by: str, zone: str, producer: str) -> DataFrame:
    """(by, body): one calendar for each group of rows of `select`, which bounds its length."""
    lines = events.select(by, "rank", event_block(zone).alias("block")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    body = F.concat_ws("\r\n", header(F.col(by).cast("string"), producer), F.transform("b", lambda x: x.block), F.lit("END:VCALENDAR"))
    return lines.select(by, F.concat(body, F.lit("\r\n")).alias("body"))
