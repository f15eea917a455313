"""iCalendar bodies to event rows: blocks, properties, recurrence, and a report of each feed.

Each body is read within its own row by array functions, so that a scan of feeds needs no shuffle; only overrides of
single occurrences are joined to their series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import zones as Z
from ..functions.places import wall_to_utc

MOST, MOST_CONFIRMED = 500, 60
#: Why a block isn't an event, in the order of the checks; longest length of an event, in seconds.
REASONS, LONGEST = ["name", "start", "rule", "duration"], 10**10
_DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
# Image properties in the order they are tried.
IMAGES = ["X-TKF-FEATURED-IMAGE", "X-WR-IMAGE", "IMAGE", "X-IMAGE", "X-MICROSOFT-CDO-IMAGE"]
INHERITED = ["description", "description_is_html", "location", "lat", "lon", "url", "image", "organizer", "tags", "privacy"]


def _lines(body: Column) -> Column:
    whole = F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), r"\n[ \t]", "")
    return F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"^[A-Za-z0-9-]+[;:]"))


def blocks(feeds: DataFrame) -> DataFrame:
    """(feed, feed_tz, nth, lines, names) for each event of feeds (feed, body); a body that is no calendar gives no rows."""
    whole = F.array_join(_lines(F.col("body")), "\n")
    head = F.split(whole, r"(?i)BEGIN:VEVENT\n", 2)
    out = feeds.filter(F.col("body").contains("BEGIN:VCALENDAR")).select("feed", whole.alias("whole"), F.get(head, F.lit(0)).alias("head"))
    found = F.regexp_extract_all("whole", F.lit(r"(?is)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))
    return out.select("feed", Z.resolve(F.regexp_extract("head", r"(?im)^X-WR-TIMEZONE[^:\n]*:(.*)$", 1)).alias("feed_tz"), F.posexplode(found).alias("nth", "block")).select(
        "feed", "feed_tz", "nth", F.split(F.regexp_replace("block", r"(?is)BEGIN:VALARM\n.*?\nEND:VALARM\n?", ""), "\n").alias("lines")
    ).withColumn("names", F.split(F.upper(F.regexp_replace(F.array_join("lines", "\n"), r"(?m)[;:].*$", "")), "\n"))


def _all(name: str) -> Column:
    return F.when(F.array_contains("names", name), F.filter("lines", lambda s, n: F.get("names", n) == name)).otherwise(F.array().cast("array<string>"))


def _line(name: str) -> Column:
    """The first line of a property: its place among the names, which are read once for a block."""
    return F.get("lines", F.array_position("names", name).cast("int") - 1)


def _value(line: Column) -> Column:
    v = F.regexp_extract(line, r'(?s)^(?:"[^"]*+"|[^":])*+:(.*)$', 1)
    return F.when(v != "", v)


def _text(line: Column) -> Column:
    """A value with its escapes undone, or null if it is blank."""
    v = F.regexp_replace(_value(line), r"\\\\", "\u0001")
    v = F.regexp_replace(F.regexp_replace(v, r"\\[nN]", "\n"), r"\\([,;])", "$1")
    v = F.btrim(F.translate(v, "\u0001", "\\"), F.lit(" \t\r\n"))
    return F.when(v != "", v)


def _param(line: Column, name: str) -> Column:
    v = F.btrim(F.regexp_extract(line, rf'(?i)^(?:"[^"]*+"|[^":])*?;{name}=("[^"]*"|[^;:]*)', 1), F.lit('"'))
    return F.when(v != "", v)


def _wall(v: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(v, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(v, F.lit("yyyyMMdd"))).cast("timestamp_ntz")


def _seconds(duration: Column) -> Column:
    """Seconds of a duration, or null if it is none, or over LONGEST."""
    n = lambda unit: F.regexp_extract(duration, rf"(\d+){unit}", 1)
    part = lambda unit, size: F.when(n(unit) == "", F.lit(0).cast("long")).otherwise(F.try_multiply(n(unit).try_cast("long"), F.lit(size).cast("long")))
    total = part("W", 604800)
    for unit, size in (("D", 86400), ("H", 3600), ("M", 60), ("S", 1)):
        total = F.try_add(total, part(unit, size))
    return F.when(duration.rlike(r"(?i)^[+-]?P(\d+W|(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?)$") & (total <= LONGEST), total)


def _utc(wall: Column, line: Column, zone: Column) -> Column:
    return F.when(_value(line).endswith("Z"), wall).otherwise(wall_to_utc(wall, zone))


def judged(feeds: DataFrame, default_zone: str) -> DataFrame:
    """properties() of the blocks of feeds, with the reason of those that are refused: no name, or a start, rule or duration that can't be read."""
    rows = properties(blocks(feeds), default_zone)
    reason = F.when(F.col("name").isNull(), "name").when(F.col("start_wall").isNull(), "start").when(~readable_rule(), "rule").when(F.col("bad_span"), "duration")
    return rows.withColumn("reason", reason).drop("bad_span")


def properties(events: DataFrame, default_zone: str) -> DataFrame:
    """One typed row for each event block; name or start_wall is null where it can't be read, and bad_span is set where a duration can't."""
    start, end, alt = _line("DTSTART"), _line("DTEND"), _line("X-ALT-DESC")
    zone = F.coalesce(Z.resolve(_param(start, "TZID")), "feed_tz", F.lit(default_zone))
    span = F.when(_line("DURATION").isNotNull(), _seconds(_value(_line("DURATION"))))
    html = F.coalesce(F.lower(_param(alt, "FMTTYPE")) == "text/html", F.lit(False)) | _text(alt).rlike(r"(?i)<[a-z](?s:.*)>")
    body = F.coalesce(F.when(html, _text(alt)), _text(_line("DESCRIPTION")))
    geo = F.split(F.coalesce(_value(_line("GEO")), F.lit("")), "[;,]")
    lat, lon = F.get(geo, F.lit(0)).try_cast("double"), F.get(geo, F.lit(1)).try_cast("double")
    pinned = (lat != 0) | (lon != 0)
    attached = F.transform(F.filter(_all("ATTACH"), lambda s: _value(s).rlike("^https?://") & (
        F.coalesce(F.lower(_param(s, "FMTTYPE")).startswith("image/"), F.lit(False)) | _value(s).rlike(r"(?i)\.(jpe?g|png|gif|webp)(\?|$)"))), _value)
    image = F.coalesce(F.get(attached, F.lit(0)), *(F.when(_text(_line(n)).rlike("^https?://"), _text(_line(n))) for n in IMAGES))
    link = _text(_line("URL"))
    plain = F.get(F.filter(U.links(body), lambda u: ~U.is_conference(u)), F.lit(0))
    named = _text(_line("ORGANIZER"))
    tags = F.array_distinct(F.filter(F.flatten(F.transform(_all("CATEGORIES"), lambda s: F.transform(F.split(_text(s), ","), lambda t: F.btrim(t)))), lambda t: t != ""))
    cls = F.lower(_text(_line("CLASS")))
    out = events.withColumns({"zone": zone, "start_wall": _wall(_value(start)), "end_line": _wall(_value(end))})
    wall_end = F.coalesce("end_line", F.timestamp_add("SECOND", span, F.col("start_wall")))
    all_day = F.coalesce(_value(start).rlike(r"^\d{8}$"), F.lit(False))
    name = _text(_line("SUMMARY"))
    override, exdates, rdates = _line("RECURRENCE-ID"), _all("EXDATE"), _all("RDATE")
    moments = lambda lines: F.flatten(F.transform(lines, lambda s: F.transform(F.split(_value(s), ","), lambda v: F.when(v.endswith("Z"), _wall(v)).otherwise(wall_to_utc(_wall(v), F.col("zone"))))))
    return out.select(
        "feed", "nth", "zone", F.coalesce(_text(_line("UID")), F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("|", name, _value(start)), 256), 1, 24))).alias("external_id"),
        name.alias("name"), "start_wall", _value(start).endswith("Z").alias("in_utc"), all_day.alias("all_day"),
        _utc(F.col("start_wall"), start, F.col("zone")).alias("starts_at"),
        F.when(all_day | (wall_end != F.col("start_wall")), F.timestamp_diff("SECOND", F.col("start_wall"), F.when(
            F.col("end_line").isNotNull() & (_value(end).endswith("Z") != _value(start).endswith("Z")),
            F.when(_value(end).endswith("Z"), F.from_utc_timestamp(F.col("end_line").cast("timestamp"), F.col("zone")).cast("timestamp_ntz")).otherwise(wall_to_utc(F.col("end_line"), F.col("zone"))),
        ).otherwise(wall_end))).alias("seconds"),
        F.when(F.upper(_text(_line("STATUS"))) == "CANCELLED", "cancelled").alias("status"),
        F.when(cls.isin("private", "confidential", "public"), cls).alias("privacy"), F.when(F.size(tags) > 0, tags).alias("tags"),
        F.coalesce(_param(_line("ORGANIZER"), "CN"), F.when(~named.rlike("(?i)^mailto:"), named)).alias("organizer"),
        body.alias("description"), (F.coalesce(html, F.lit(False)) | F.coalesce(body.rlike(r"(?i)<(p|br|a|div|ul|ol|li|b|i|strong|em|h[1-6]|span)\b[^>]*>"), F.lit(False))).alias("description_is_html"),
        F.when(pinned, lat).alias("lat"), F.when(pinned, lon).alias("lon"), image.alias("image"), F.coalesce(F.when(link.rlike("(?i)^https?://"), link), plain).alias("url"),
        _text(_line("LOCATION")).alias("location"), _value(_line("SEQUENCE")).try_cast("int").alias("sequence"), _wall(_value(_line("LAST-MODIFIED"))).alias("last_modified"),
        F.upper(_value(_line("RRULE"))).alias("rule"), moments(exdates).alias("exdates"), moments(rdates).alias("rdates"),
        _utc(_wall(_value(override)), override, F.coalesce(Z.resolve(_param(override, "TZID")), F.col("zone"))).alias("overrides"),
        (_line("DURATION").isNotNull() & span.isNull()).alias("bad_span"),
    )


def _part(name: str) -> Column:
    v = F.regexp_extract("rule", rf"(?:^|;){name}=([^;]*)", 1)
    return F.when(v != "", v)


def _listed(one: str) -> str:
    return f"(?:{one})(?:,(?:{one}))*"


_TO_366 = r"[+-]?(?:[1-9]\d?|[12]\d\d|3[0-5]\d|36[0-6])"
_TO_53 = r"[+-]?(?:[1-9]|[1-4]\d|5[0-3])"
_TO_31 = r"[+-]?(?:[1-9]|[12]\d|3[01])"
#: What each part of a rule may hold.
PARTS = {
    "FREQ": "HOURLY|DAILY|WEEKLY|MONTHLY|YEARLY", "INTERVAL": r"0*[1-9]\d{0,5}", "COUNT": r"0*[1-9]\d{0,8}", "UNTIL": r"\d{8}(?:T\d{6}Z?)?", "WKST": "|".join(_DAYS),
    "BYDAY": _listed(f"(?:{_TO_53})?(?:{'|'.join(_DAYS)})"), "BYMONTHDAY": _listed(_TO_31), "BYMONTH": _listed(r"0?[1-9]|1[0-2]"), "BYSETPOS": _listed(_TO_366),
    "BYWEEKNO": _listed(_TO_53), "BYYEARDAY": _listed(_TO_366), "BYHOUR": _listed(r"[01]?\d|2[0-3]"), "BYMINUTE": _listed(r"[0-5]?\d"), "BYSECOND": _listed(r"[0-5]?\d"),
}


def readable_rule() -> Column:
    """Whether a rule has only known parts with values in their ranges: hours to years, week and day numbers with years, numbered weekdays with months or years."""
    one = "|".join(f"{name}=(?:{value})" for name, value in PARTS.items())
    freq = _part("FREQ")
    ok = F.col("rule").rlike(f"^(?:{one})(?:;(?:{one}))*;?$") & freq.isNotNull()
    ok &= (_part("UNTIL").isNull() | _wall(_part("UNTIL")).isNotNull()) & ((freq == "YEARLY") | (_part("BYWEEKNO").isNull() & _part("BYYEARDAY").isNull()))
    numbered = F.coalesce(_part("BYDAY").rlike(r"\d"), F.lit(False))
    return F.col("rule").isNull() | F.coalesce(ok & (~numbered | (freq.isin("MONTHLY", "YEARLY") & _part("BYWEEKNO").isNull())), F.lit(False))


_NO_DAYS = "array<date>"


def _parts(until: Column, most: Column) -> Column:
    """struct of a rule's parts, read once for each row: r.stop is the last day to look at, r.last the moment that UNTIL names, r.most how many occurrences count."""
    last_text = _part("UNTIL")
    last = F.when(last_text.endswith("Z") & ~F.col("in_utc"), F.from_utc_timestamp(_wall(last_text).cast("timestamp"), F.col("zone")).cast("timestamp_ntz")).otherwise(_wall(last_text))
    last = F.when(last_text.rlike(r"^\d{8}$"), F.timestamp_add("SECOND", F.lit(86399), last)).otherwise(last)
    numbers = lambda name: F.array_distinct(F.transform(F.split(_part(name), ","), lambda x: x.try_cast("int")))
    first, freq, gap = F.to_date("start_wall"), _part("FREQ"), F.coalesce(_part("INTERVAL").try_cast("int"), F.lit(1))
    by_day = F.transform(F.split(_part("BYDAY"), ","), lambda t: F.struct(
        F.coalesce(F.regexp_extract(t, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), (F.array_position(F.array(*map(F.lit, _DAYS)), F.right(t, F.lit(2))) - 1).cast("int").alias("day")))
    here = lambda of: F.array(of("start_wall").cast("int"))
    seconds = F.coalesce(numbers("BYSECOND"), here(F.second))
    minutes = F.coalesce(numbers("BYMINUTE"), here(F.minute))
    hours = F.when(freq == "HOURLY", F.array(F.lit(0))).otherwise(F.coalesce(numbers("BYHOUR"), here(F.hour)))
    clocks = F.flatten(F.transform(hours, lambda h: F.flatten(F.transform(minutes, lambda m: F.transform(seconds, lambda s: h * 3600 + m * 60 + s)))))
    stop = F.least(until, F.coalesce(F.to_date(last), until))
    return F.struct(
        first.alias("first"), F.col("start_wall").alias("start"), freq.alias("freq"), gap.alias("gap"), last.alias("last"), stop.alias("stop"), F.least(F.coalesce(_part("COUNT").try_cast("int"), most), most).alias("most"),
        by_day.alias("by_day"), numbers("BYMONTHDAY").alias("by_date"), numbers("BYMONTH").alias("by_month"), numbers("BYSETPOS").alias("places"), numbers("BYWEEKNO").alias("by_week"), numbers("BYYEARDAY").alias("by_year_day"),
        F.when(freq == "HOURLY", numbers("BYHOUR")).alias("by_hour"), (F.coalesce(F.array_position(F.array(*map(F.lit, _DAYS)), _part("WKST")), F.lit(1)) - 1).cast("int").alias("week_day"), F.array_sort(clocks).alias("clocks"),
    )


def _week(r: Column, d: Column) -> Column:
    return F.date_sub(d, F.pmod(F.weekday(d) - r.week_day, F.lit(7)).cast("int"))


def _let(value: Column, body) -> Column:
    """body(value), worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limited(r: Column, days: Column, month: bool = True, date: bool = True) -> Column:
    """Those of the days that the rule's months and dates allow."""
    out = days
    if month:
        out = F.when(r.by_month.isNull(), out).otherwise(F.filter(out, lambda d: F.array_contains(r.by_month, F.month(d))))
    if date:
        out = F.when(r.by_date.isNull(), out).otherwise(F.filter(out, lambda d: F.array_contains(r.by_date, F.dayofmonth(d)) | F.array_contains(r.by_date, F.dayofmonth(d) - F.dayofmonth(F.last_day(d)) - 1)))
    return out


def _weekdays_in(r: Column, low: Column, high: Column) -> Column:
    """The rule's weekdays between two days: all of one name, or the nth from the beginning or the end."""

    def of(x: Column) -> Column:
        head = F.date_add(low, F.pmod(x.day - F.weekday(low), F.lit(7)).cast("int"))
        tail = F.date_sub(high, F.pmod(F.weekday(high) - x.day, F.lit(7)).cast("int"))
        nth = F.when(x.n > 0, F.date_add(head, 7 * (x.n - 1))).otherwise(F.date_add(tail, 7 * (x.n + 1)))
        return F.when(x.n == 0, F.sequence(head, tail, F.expr("interval 7 days"))).otherwise(F.filter(F.array(nth), lambda d: d.between(low, high)))

    return F.flatten(F.transform(r.by_day, of))


def _in_month(r: Column, low: Column) -> Column:
    """Days of the month that begins with low: by weekday, by date, by both, or on the date of the first."""
    size = F.dayofmonth(F.last_day(low))
    at = lambda n: F.when(n.between(1, size), F.date_add(low, n - 1))
    dated = F.array_compact(F.transform(F.coalesce(r.by_date, F.array(F.dayofmonth(r.first))), lambda n: at(F.when(n < 0, size + n + 1).otherwise(n))))
    return F.when(r.by_day.isNull(), dated).otherwise(_limited(r, _weekdays_in(r, low, F.last_day(low)), month=False))


def _in_year(r: Column, y: Column) -> Column:
    """Days of a year: by number of the week or the day, by weekday, or of its months."""
    low, high = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))
    one = lambda year: _week(r, F.make_date(year, F.lit(1), F.lit(4)))  # noqa: E731 the first week has four days or more
    names = F.coalesce(F.transform(r.by_day, lambda x: x.day), F.array(F.weekday(r.first)))
    week = lambda n: F.date_add(one(y), (7 * (n - 1)).cast("int"))
    weeks = (F.date_diff(one(y + 1), one(y)) / 7).cast("int")
    in_weeks = F.flatten(F.transform(F.filter(F.transform(r.by_week, lambda n: F.when(n < 0, weeks + n + 1).otherwise(n)), lambda n: n.between(1, weeks)),
                                     lambda n: F.transform(names, lambda d: F.date_add(week(n), F.pmod(d - r.week_day, F.lit(7)).cast("int")))))
    numbered = F.filter(F.transform(r.by_year_day, lambda n: F.when(n < 0, F.date_add(high, n + 1)).otherwise(F.date_add(low, n - 1))), lambda d: d.between(low, high))
    numbered = F.when(r.by_day.isNull(), numbered).otherwise(F.filter(numbered, lambda d: F.exists(r.by_day, lambda x: x.day == F.weekday(d))))
    months = F.coalesce(r.by_month, F.when(r.by_date.isNotNull(), F.sequence(F.lit(1), F.lit(12))), F.array(F.month(r.first)))
    return (
        F.when(r.by_week.isNotNull(), _limited(r, in_weeks)).when(r.by_year_day.isNotNull(), _limited(r, numbered))
        .when(r.by_day.isNotNull() & r.by_month.isNull(), _limited(r, _weekdays_in(r, low, high), month=False))
        .otherwise(F.flatten(F.transform(months, lambda m: _in_month(r, F.make_date(y, m, F.lit(1))))))
    )


def _moments(r: Column, k: Column) -> Column:
    """Wall-clock times of the rule's k-th period from the first on, in order, before BYSETPOS."""
    none = F.array().cast(_NO_DAYS)
    one = F.date_add(r.first, k * r.gap)
    on_name = lambda d: F.coalesce(F.exists(r.by_day, lambda x: x.day == F.weekday(d)), F.lit(True))
    week = F.date_add(_week(r, r.first), 7 * k * r.gap)
    names = F.coalesce(F.transform(r.by_day, lambda x: x.day), F.array(F.weekday(r.first)))
    hour = F.timestamp_add("HOUR", (k * r.gap).cast("long"), F.date_trunc("hour", r.start).cast("timestamp_ntz"))
    days = (
        F.when(r.freq == "DAILY", _limited(r, F.when(on_name(one), F.array(one)).otherwise(none)))
        .when(r.freq == "WEEKLY", _limited(r, F.transform(names, lambda d: F.date_add(week, F.pmod(d - r.week_day, F.lit(7)).cast("int")))))
        .when(r.freq == "MONTHLY", _let(F.add_months(F.trunc(r.first, "MM"), k * r.gap), lambda low: F.when(F.coalesce(F.array_contains(r.by_month, F.month(low)), F.lit(True)), _in_month(r, low)).otherwise(none)))
        .when(r.freq == "YEARLY", _in_year(r, F.year(r.first) + k * r.gap))
    )
    by_day = F.flatten(F.transform(F.array_sort(F.array_distinct(days)), lambda d: F.transform(r.clocks, lambda c: F.timestamp_add("SECOND", c.cast("long"), d.cast("timestamp_ntz")))))
    right_hour = F.coalesce(F.array_contains(r.by_hour, F.hour(hour)), F.lit(True)) & on_name(F.to_date(hour)) & (F.size(_limited(r, F.array(F.to_date(hour)))) > 0)
    by_hour = F.when(right_hour, F.transform(r.clocks, lambda c: F.timestamp_add("SECOND", c.cast("long"), hour))).otherwise(F.array().cast("array<timestamp_ntz>"))
    return F.when(r.freq == "HOURLY", by_hour).otherwise(by_day)


def _placed(r: Column, moments: Column) -> Column:
    """Of a period's times those at the rule's places, from the beginning or the end."""
    picked = lambda all_: F.array_compact(F.transform(r.places, lambda n: F.get(all_, F.when(n > 0, n - 1).otherwise(F.size(all_) + n))))
    return F.when(r.places.isNull(), moments).otherwise(_let(moments, lambda all_: F.array_sort(F.array_distinct(picked(all_)))))


def _walls(r: Column) -> Column:
    months = (F.year(r.stop) - F.year(r.first)) * 12 + F.month(r.stop) - F.month(r.first)
    length = (
        F.when(r.freq == "HOURLY", 24 * F.date_diff(r.stop, r.first).cast("long") + 23).when(r.freq == "DAILY", F.date_diff(r.stop, r.first)).when(r.freq == "WEEKLY", F.date_diff(r.stop, _week(r, r.first)) / 7)
        .when(r.freq == "MONTHLY", months).otherwise(F.year(r.stop) - F.year(r.first) + r.by_week.isNotNull().cast("int"))
    )
    periods = F.floor(length / r.gap)
    # where no period is empty, but for the first, there are no more periods than occurrences
    full = r.freq.isin("HOURLY", "DAILY", "WEEKLY") & r.by_month.isNull() & r.by_date.isNull() & r.places.isNull() & r.by_hour.isNull() & ((r.freq == "WEEKLY") | r.by_day.isNull())
    last = F.least(periods, F.when(full, r.most.cast("long")).otherwise(periods)).cast("int")
    each = F.when(r.stop < r.first, F.array().cast("array<array<timestamp_ntz>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: _placed(r, _moments(r, k))))
    end = F.timestamp_add("SECOND", F.lit(86399), r.stop.cast("timestamp_ntz"))
    inside = F.filter(F.flatten(each), lambda w: (w >= r.start) & (w <= end) & F.coalesce(w <= r["last"], F.lit(True)))
    # weeks by number may reach into the next year's
    ordered = F.when(r.by_week.isNull(), inside).otherwise(F.array_sort(F.array_distinct(inside)))
    return F.slice(ordered, F.lit(1), r.most)


def occurrences(until: Column, most: Column | None = None) -> Column:
    """array<timestamp_ntz>: the first `most` wall-clock starts of a readable rule up to a date, COUNT included, before EXDATE and RDATE.

    Each period's days follow from its first day by arithmetic, so a series costs its periods up to that date, and no more of them than
    occurrences where none is empty.
    """
    return F.flatten(F.transform(F.array(_parts(until, F.lit(2**31 - 1) if most is None else most)), _walls))


def confirmed(rows: DataFrame, now: Column, days: int = 90, most: int = MOST_CONFIRMED) -> DataFrame:
    """Confirmed rows (external_id, starts_at, ends_at, zone, rule, ...) with their occurrences up to `days` ahead, `most` at best.

    Occurrences keep the wall-clock time across changes of the clock, and their length; a row without a readable rule stays as it is.
    """
    wall = F.from_utc_timestamp(F.col("starts_at").cast("timestamp"), F.col("zone")).cast("timestamp_ntz")
    ready = rows.withColumns({"rule": F.upper(F.regexp_replace("rule", "(?i)^RRULE:", "")), "start_wall": wall, "in_utc": F.lit(False)})
    span = F.timestamp_diff("SECOND", F.col("starts_at"), F.col("ends_at"))
    found = F.when(F.col("rule").isNotNull() & readable_rule(), F.slice(F.filter(F.transform(occurrences(F.to_date(now + F.expr(f"interval {days + 1} days")), F.lit(most)), lambda w: wall_to_utc(w, F.col("zone"))), lambda u: u <= now + F.expr(f"interval {days} days")), 1, most))
    out = ready.withColumn("at", F.explode(F.coalesce(found, F.array("starts_at"))))
    repeats = F.col("rule").isNotNull() & readable_rule()
    return out.select(
        *(c for c in rows.columns if c not in ("starts_at", "ends_at", "rule")), F.col("at").alias("starts_at"), F.timestamp_add("SECOND", span, F.col("at")).alias("ends_at"),
        F.when(repeats, F.col("at")).alias("occurrence"), F.when(repeats, F.col("external_id")).alias("series_key"),
    )


def expand(rows: DataFrame, begin: Column, end: Column, most: int = MOST, good: Column | None = None) -> DataFrame:
    """Occurrences of rows of `properties` that overlap a window of UTC times; of the rows for which `good` holds.

    The first `most` of a series are looked at.  A row with RECURRENCE-ID replaces the occurrence of its series at that
    time and takes what it leaves out from the series; without a series it stands alone.  Rules must be readable_rule()s.  Of rows with one UID and
    occurrence the last in the feed counts; of equal overrides, that with the greatest SEQUENCE.

    One pass and one shuffle: series and overrides are exploded together and meet by UID and occurrence.
    """
    repeats = F.col("rule").isNotNull() | (F.size("rdates") > 0)
    to_utc = lambda w: F.when(F.col("in_utc"), w).otherwise(wall_to_utc(w, F.col("zone")))
    found = F.when(F.col("rule").isNotNull(), F.transform(occurrences(F.date_add(F.to_date(end), 1), F.lit(most) + F.coalesce(F.size("exdates"), F.lit(0))), to_utc)).otherwise(F.array("starts_at"))
    every = F.slice(F.array_sort(F.array_distinct(F.concat(F.array_except(found, F.coalesce("exdates", F.array().cast("array<timestamp_ntz>"))), "rdates"))), 1, most)
    at = lambda times: F.transform(times, lambda t: F.struct(t.alias("occurrence"), t.alias("starts_at")))
    own = lambda key: F.array(F.struct(key.alias("occurrence"), F.col("starts_at").alias("starts_at")))
    times = F.when(F.col("overrides").isNotNull(), own(F.col("overrides"))).when(repeats, at(every)).otherwise(own(F.lit(None).cast("timestamp_ntz")))
    # within explode(), so that no filter works the times out once more
    each = rows.withColumn("x", F.explode(times if good is None else F.when(good, times)))
    key, mine = ["feed", "external_id", "occurrence"], F.col("overrides").isNotNull()
    names = [c for c in rows.columns if c not in (*key, "overrides", "rule", "exdates", "rdates", "starts_at", "nth", "reason")]
    each = each.select("feed", "external_id", "x.*", mine.alias("mine"), "nth", *names, F.when(mine | repeats, F.col("external_id")).alias("series_key"))
    names += ["starts_at", "series_key"]
    met = each.groupBy(*key).agg(
        F.max_by(F.struct(*names), F.when(~F.col("mine"), F.col("nth"))).alias("m"),
        F.max_by(F.struct(*names), F.when(F.col("mine"), F.struct(F.coalesce("sequence", F.lit(-1)), "starts_at", "nth"))).alias("o"),
    )
    pick = lambda c: (F.coalesce(F.col(f"o.{c}"), F.col(f"m.{c}")) if c in INHERITED else F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"m.{c}"))).alias(c)
    out = met.select(*key, *map(pick, names))
    wall = F.when(F.col("in_utc"), F.col("starts_at")).otherwise(F.from_utc_timestamp(F.col("starts_at").cast("timestamp"), F.col("zone")).cast("timestamp_ntz"))
    ends = F.timestamp_add("SECOND", F.col("seconds"), wall)
    out = out.withColumn("ends_at", F.when(F.col("in_utc"), ends).otherwise(wall_to_utc(ends, F.col("zone"))))
    shown = F.coalesce("ends_at", F.timestamp_add("SECOND", F.when(F.col("all_day"), 86400).otherwise(3600), F.col("starts_at")))
    return out.filter((shown > begin) & (F.col("starts_at") < end)).drop("start_wall", "in_utc", "seconds")


def read(feeds: DataFrame, begin: Column, end: Column, default_zone: str) -> tuple[DataFrame, DataFrame]:
    """(events, report) of feeds (feed, body).

    The report has a row for each feed: dropped (blocks that judged() refuses), complete (a calendar
    of which nothing was dropped), and the window seen, which reaches to the end of the window asked for where a rule has
    no end.
    """
    rows = judged(feeds, default_zone)
    good = F.col("reason").isNull()
    events = expand(rows, begin, end, good=good)
    open_end = F.col("rule").isNotNull() & _part("COUNT").isNull() & _part("UNTIL").isNull()
    seen = rows.groupBy("feed").agg(F.count_if(~good).alias("dropped"), F.max(open_end).alias("open"), F.min(F.when(good, F.col("starts_at"))).alias("low"), F.max(F.when(good, F.col("starts_at"))).alias("high"))
    spread = events.groupBy("feed").agg(F.max("starts_at").alias("latest"))
    report = feeds.select("feed", F.coalesce(F.col("body").contains("BEGIN:VCALENDAR"), F.lit(False)).alias("calendar")).join(seen, "feed", "left").join(spread, "feed", "left")
    high = F.greatest("high", "latest")
    return events, report.select(
        "feed", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), (F.col("calendar") & (F.coalesce("dropped", F.lit(0)) == 0)).alias("complete"),
        F.col("low").alias("window_from"), F.when(F.col("open"), F.greatest(high, end)).otherwise(high).alias("window_to"),
    )
