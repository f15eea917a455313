"""Golden cases of sources and streams that the derived payloads don't reach."""

import tempfile

from pyspark.sql import functions as F

from tidewheel.functions import zones
from tidewheel.operators import cards, export
from tidewheel.plans import streams
from tidewheel.sources import calendar, delimited, pages, push
from tidewheel.streaming import state, upsert

FEED = "\r\n".join([
    "BEGIN:VCALENDAR", "X-WR-TIMEZONE:America/Denver", "BEGIN:VEVENT", "UID:a", "DTSTART;TZID=Mountain Standard Time:20240301T180000", "DTEND;TZID=America/Denver:20240301T193000",
    "RRULE:FREQ=WEEKLY;COUNT=4;BYDAY=FR", "EXDATE;TZID=America/Denver:20240308T180000", "SUMMARY:Jazz\\, ", " blues", "CATEGORIES:music, art,music", 'ORGANIZER;CN="Ann: B":mailto:x@y.z', "BEGIN:VALARM",
    "DESCRIPTION:no", "END:VALARM", "END:VEVENT", "BEGIN:VEVENT", "UID:a", "RECURRENCE-ID;TZID=America/Denver:20240315T180000", "DTSTART;TZID=America/Denver:20240316T180000", "SUMMARY:Moved", "END:VEVENT",
    "BEGIN:VEVENT", "UID:d", "DTSTART;VALUE=DATE:20240310", "SUMMARY:Fair", "END:VEVENT", "BEGIN:VEVENT", "UID:x", "DTSTART:20240310T000000Z", "END:VEVENT", "END:VCALENDAR", "",
])


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_calendar(spark):
    feeds = spark.createDataFrame([("f", FEED), ("g", "nope"), ("h", None)], "feed string, body string")
    events, report = calendar.read(feeds, at("2024-01-01"), at("2024-05-01"), "UTC")
    e = {(r.external_id, str(r.occurrence)): r for r in events.collect()}
    # 22 March is in summer time, the first of March isn't; the 8th is excluded, and the 15th was moved.
    assert sorted(e) == [("a", "2024-03-02 01:00:00"), ("a", "2024-03-16 00:00:00"), ("a", "2024-03-23 00:00:00"), ("d", "None")]
    first, moved, fair = e["a", "2024-03-02 01:00:00"], e["a", "2024-03-16 00:00:00"], e["d", "None"]
    assert first.name == "Jazz, blues" and first.tags == ["music", "art"] and first.organizer == "Ann: B" and first.description is None and str(first.ends_at) == "2024-03-02 02:30:00"
    assert moved.name == "Moved" and str(moved.starts_at) == "2024-03-17 00:00:00" and moved.tags == ["music", "art"]
    assert fair.all_day and str(fair.starts_at) == "2024-03-10 07:00:00"
    r = {x.feed: x for x in report.collect()}
    assert (r["f"].dropped, r["f"].complete) == (1, False) and (r["g"].dropped, r["g"].complete) == (0, False) and not r["h"].complete


def test_empty_calendar(spark):
    events, report = calendar.read(spark.createDataFrame([], "feed string, body string"), at("2024-01-01"), at("2024-05-01"), "UTC")
    assert events.count() == 0 and report.count() == 0


def test_fold(spark):
    out = spark.range(1).select(export.fold(F.lit("x" * 74)).alias("a"), export.fold(F.lit("x" * 146)).alias("b"), export.fold(F.lit("x" * 147)).alias("c")).first()
    assert out.a == "x" * 74 and out.b == "x" * 73 + "\r\n " + "x" * 73 and out.c.endswith("\r\n x")


def test_pages(spark):
    p = spark.createDataFrame([(1, "https://c.org/p/q", '<title> T </title><a href="webcal://d.org/a.ics">c</a><a href="e.ics">c</a>'), (2, None, None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in pages.facts(p).collect()}
    assert found[1].title == "T" and found[1].calendar_links == ["https://d.org/a.ics", "https://c.org/p/e.ics"] and found[2].calendar_links == []
    broken = spark.createDataFrame([(1, "https://c.org", '<script type="application/ld+json">{"@type":"Event",</script>')], "page_id long, url string, html string")
    assert pages.linked_events(broken).count() == 0


def test_headers():
    m = delimited.guess(["Event Name", "Date", "Start Time", "Venue", "Foo"])
    assert (m["name"], m["start"], m["startTime"], m["location"], m["end"]) == ("Event Name", "Date", "Start Time", "Venue", None) and delimited.unmapped(["Foo", "Date"], m) == ["Foo"]
    assert delimited.guess(["Date", "Foo"], {"name": "Foo"})["name"] == "Foo"


def test_dates(spark):
    cases = {("3/5/2024", "7:30 pm"): "2024-03-05T19:30:00", ("March 5, 2024", ""): "2024-03-05", ("soon", ""): None, ("2024-03-05T10:00:00-07:00", None): "2024-03-05T10:00:00-07:00",
             ("3/5/2024 7 PM", None): "2024-03-05T19:00:00", ("Tuesday, March 5, 2024", "9pm"): "2024-03-05T21:00:00"}
    rows = spark.createDataFrame(list(cases), "d string, t string")
    assert {(r.d, r.t): r.x for r in rows.select("d", "t", delimited.moment(F.col("d"), F.col("t"))[0].alias("x")).collect()} == cases


def test_push(spark):
    calls = spark.createDataFrame([("a", 0, '{"externalId":"1","name":" N ","start":"s","tags":["x"]}'), ("a", 1, '{"externalId":"2"}'), ("a", 2, "{"), ("b", 0, '{"externalId":"1","name":"n","start":"s"}'), ("b", 200, "{}")], "call string, item int, payload string")
    good, bad = push.parse(calls)
    assert [(r.external_id, r.name, r.tags) for r in good.collect()] == [("1", "N", ["x"])]
    assert sorted((r.call, r.item, r.reason) for r in bad.collect()) == [("a", 1, "missing field"), ("a", 2, "not json"), ("b", 0, "too many"), ("b", 200, "too many")]


def test_labels(spark):
    row = spark.range(1).select(
        cards.when_label(at("2024-07-01 18:30:00"), F.lit("America/Denver"), at("2024-07-01 20:00:00"), F.lit(False)).alias("a"),
        cards.when_label(at("2024-07-01 06:00:00"), F.lit("America/Denver"), at("2024-07-04 06:00:00"), F.lit(True)).alias("b"),
        cards.when_label(at("2024-07-01 18:00:00"), F.lit("Europe/Berlin"), F.lit(None).cast("timestamp_ntz"), F.lit(False)).alias("c"), zones.resolve(F.lit("")).alias("d")).first()
    assert row.a == "Mon, Jul 1 · 12:30 PM – 2 PM MDT" and row.b == "Mon, Jul 1 – Wed, Jul 3 (all day)" and row.c == "Mon, Jul 1 · 8 PM GMT+2" and row.d is None


def _stream(spark, rows, schema, parts=1):
    path = tempfile.mkdtemp(prefix="spark-")
    for part in range(parts):
        spark.createDataFrame(rows[part::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_missing_stream(spark):
    t = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    steps = [(0, True, True, "touch"), (1, True, False, "missing"), (2, False, False, "leave"), (3, True, False, "missing"), (8, True, False, "cancel"), (9, True, False, "leave"), (200, True, False, "remove")]
    rows = spark.createDataFrame([(1, "k", t(h), c, s) for h, c, s, _ in steps], "source long, key string, at string, complete boolean, seen boolean").withColumn("at", F.col("at").cast("timestamp"))
    path = tempfile.mkdtemp(prefix="spark-")
    rows.write.mode("overwrite").parquet(path)
    out = streams._stateful(spark, state.missing(spark.readStream.schema(rows.schema).parquet(path)))
    assert [r.action for r in out.orderBy("at").collect()] == [a for *_, a in steps]


def test_upsert_stream_skips_what_is_known(spark):
    place = tempfile.mkdtemp(prefix="spark-")
    rows = _stream(spark, [(1, 1, "a"), (2, 1, "b")], "key long, at long, hash string", parts=2)
    upsert.write(rows, f"{place}/t", f"{place}/s", ["key"], ["at"], "hash").awaitTermination()
    assert {(r.key, r.hash) for r in upsert.read(spark, f"{place}/t", ["key"], ["at"]).collect()} == {(1, "a"), (2, "b")}
