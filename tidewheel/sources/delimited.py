"""Delimited files with free headers to raw rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raw import blank, raw

# The header names that each field is known by, in the order of the fields.
HEADERS = {
    "name": r"^(event ?)?(name|title|summary|event)$", "start": r"^(start( ?date)?|date|starts?|begin(s)?|when|event ?date|start_?date)$", "startTime": r"^(start ?time|time|start_?time)$",
    "end": r"^(end( ?date)?|ends?|finish|until|end_?date)$", "endTime": r"^(end ?time|end_?time)$", "location": r"^(location|venue|place|where|address)$",
    "description": r"^(description|details|about|body|notes|summary text)$", "url": r"^(url|link|website|rsvp|tickets?|more info)$", "image": r"^(image|image ?url|photo|cover|flyer)$",
    "price": r"^(price|cost|fee|admission)$", "tags": r"^(tags?|categor(y|ies)|type)$", "id": r"^(id|uid|event ?id|external ?id)$",
}
# Spellings of times with a date, of dates and of times, in order; weekdays in front are dropped.
DATE_TIMES = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd h:mm a", "M/d/yyyy H:mm", "M/d/yyyy h:mm a", "M/d/yyyy h a", "MMMM d, yyyy h:mm a", "MMM d, yyyy h:mm a", "M/d/yy h:mm a"]
DATES = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "yyyy/MM/dd"]
TIMES = ["H:mm", "h:mm a", "h a", "ha", "h:mma", "HH:mm:ss"]


def guess(headers: list[str], given: dict[str, str | None] | None = None) -> dict[str, str | None]:
    """The header of each field: as given, else the first unused one that its pattern knows."""
    found: dict[str, str | None] = {}
    for field, pattern in HEADERS.items():
        free = [h for h in headers if h not in found.values() and re.match(pattern, h.strip(), re.I)]
        found[field] = (given or {}).get(field, free[0] if free else None)
    return found


def unmapped(headers: list[str], mapping: dict[str, str | None]) -> list[str]:
    return [h for h in headers if h not in mapping.values()]


def moment(date: Column, clock: Column) -> tuple[Column, Column]:
    """(ISO text, whether it is a date only) of a date text, which may hold its time, and a time text."""
    d = F.regexp_replace(blank(date), r"(?i)^[a-z]+day,\s+|^(mon|tue|wed|thu|fri|sat|sun),\s+", "")
    t = F.upper(F.regexp_replace(blank(clock), r"\s+", " "))
    parse = lambda c, form: F.try_to_timestamp(c, F.lit(form))
    whole = F.when(d.rlike(r"^\d{4}-\d\d-\d\dT\d"), d)
    both = F.coalesce(*(parse(F.regexp_replace(F.regexp_replace(d, r"(?i)\bam$", "AM"), r"(?i)\bpm$", "PM"), f) for f in DATE_TIMES))
    day = F.coalesce(*(parse(d, f) for f in DATES), F.when(whole.isNotNull(), F.to_timestamp(F.try_to_date(F.substring(d, 1, 10), "yyyy-MM-dd"))))
    hour = F.coalesce(*(parse(F.concat(F.lit("2000-01-01 "), t), f"yyyy-MM-dd {f}") for f in TIMES))
    merged = F.when(day.isNotNull() & hour.isNotNull(), F.concat(F.date_format(day, "yyyy-MM-dd'T'"), F.date_format(hour, "HH:mm:ss")))
    text = F.coalesce(merged, whole, F.date_format(both, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(day, "yyyy-MM-dd"))
    return text, text.rlike(r"^\d{4}-\d\d-\d\d$")


def events(rows: DataFrame, mapping: dict[str, str | None], zone: str, file_key: Column, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(raw rows, dropped rows) of a file read with its header; a row needs a name and a start."""
    get = lambda f: F.col(f"`{mapping[f]}`").cast("string") if mapping.get(f) else F.lit(None).cast("string")
    start, all_day = moment(get("start"), get("startTime"))
    end, _ = moment(F.coalesce(blank(get("end")), F.when(blank(get("endTime")).isNotNull(), get("start"))), get("endTime"))
    name, cost = blank(get("name")), blank(get("price"))
    key = F.coalesce(blank(get("id")), F.concat(F.lit("csv_"), F.substring(F.sha2(F.concat_ws("\u0000", file_key, name, start), 256), 1, 16)))
    tags = F.filter(F.transform(F.split(get("tags"), "[,;|]"), lambda t: F.btrim(t)), lambda t: t != "")
    good = name.isNotNull() & start.isNotNull()
    out = raw(
        rows, keep, external_id=key, name=name, start=start, end=end, tz=F.lit(zone), all_day=all_day, description=blank(get("description")), url=blank(get("url")), image=blank(get("image")),
        location=blank(get("location")), price=cost, tags=F.when(F.size(tags) > 0, tags),
    )
    return out, rows.filter(~good)
