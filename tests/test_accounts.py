"""Sources, overrides, previews and exports by hand-made cases."""

import json

from pyspark.sql import functions as F

from tidewheel.operators import account, confirm, upkeep
from tidewheel.sources import api, connector, delta, records, rewrite


def test_connector(spark):
    class Two(connector.Connector):
        type, delta = "two_pages", True

        def fetch(self, config, cursor):
            for n in range(2):
                item = {"id": f"{config['source']}{n}", "summary": "s", "start": {"date": "2024-02-01"}}
                yield json.dumps({"items": [item]}), f"c{n}"

    connector.register(spark, Two)
    rows = spark.read.format("two_pages").option("sources", json.dumps([{"source": "a"}, {"source": "b", "cursor": "c"}])).load()
    assert rows.rdd.getNumPartitions() == 2
    assert sorted((r.source, r.page, r.complete, r.cursor) for r in rows.collect()) == [("a", 0, True, "c0"), ("a", 1, True, "c1"), ("b", 0, False, "c0"), ("b", 1, False, "c1")]
    assert sorted(r.external_id for r in api.google(rows).collect()) == ["a0", "a1", "b0", "b1"]


def test_rewrite(spark):
    rows = spark.createDataFrame([("https://lu.ma/abcdef1", "https://luma.com/x", "evt-1@e"), (None, "https://other.org/", "evt-1@e"), (None, None, "x")], "description string, url string, external_id string").withColumn("image", F.lit("i"))
    assert [(r.url, r.image) for r in rewrite.luma(rows).collect()] == [("https://lu.ma/abcdef1", None), ("https://lu.ma/evt-1", None), (None, None)]
    assert [r.url for r in rewrite.meetup(rows.withColumn("url", F.lit(None).cast("string")).withColumn("external_id", F.lit("event_9z@meetup.com")), F.lit("g")).distinct().collect()][:1] == ["https://www.meetup.com/g/events/9z/"]


def test_records(spark):
    ok = {"name": " N ", "startsAt": "s", "locations": [{"$type": "a.location.address", "name": "Old"}, {"$type": "a.location.address", "locality": "L"}, {"name": "Yard"}, {"$type": "a.location.geo", "latitude": "x", "longitude": "1"}]}
    texts = [json.dumps(ok), "{", None, json.dumps(ok | {"additionalData": {"externalSource": {"id": 1}}}), json.dumps({"name": "N"}), json.dumps({"name": "Bare", "startsAt": "s"})]
    rows = spark.createDataFrame([(f"at://d/c/{n}", "d", "h", t) for n, t in enumerate(texts)], "uri string, did string, host string, record string")
    found = {r.external_id: r for r in records.read(rows).collect()}
    assert set(found) == {"0", "5"} and found["5"].locations is None and found["0"].name == "N"
    assert (found["0"].locations[0].name, found["0"].locations[0].locality, found["0"].locations[0].lat) == ("Yard", "L", None)


def test_delta_failure(spark):
    page = lambda **k: json.dumps({"items": [{"id": "1", "summary": "s", "start": {"date": "2024-02-01"}}], **k})
    rows = spark.createDataFrame([("a", 1, 0, "t", 200, page(nextSyncToken="u")), ("b", 1, 0, None, 200, page()), ("b", 1, 1, None, 403, None)], "source string, fetch int, page int, token string, status int, payload string")
    found, fetches = delta.google(rows)
    assert [(r.source, r.complete) for r in found.collect()] == [("a", False)]
    assert {(r.source, r.failed, r.cursor) for r in fetches.collect()} == {("a", False, "u"), ("b", True, None)}


def test_empty_confirmation(spark):
    items = spark.createDataFrame([], "item long, host long, kind string, extracted array<struct<external_id:string,name:string>>, event long, to string, source_default string, resolved_at timestamp")
    decisions = spark.createDataFrame([(1, 1, "confirm")], "item long, host long, action string")
    out = confirm.outcomes(decisions, items)
    assert [r.outcome for r in out.collect()] == ["not-found"]
    assert confirm.extracted(out, spark.createDataFrame([], "item long, external_id string, name string")).count() == 0


def test_export_and_preview(spark):
    hosts = spark.createDataFrame([(1, "a"), (2, "b")], "host long, name string")
    sources, rules = spark.createDataFrame([(1, 7)], "host long, source long"), spark.createDataFrame([(7, "held"), (8, "public")], "source long, level string")
    events = spark.range(50).select(F.lit(1).cast("long").alias("host"), "id")
    docs = [(r.host, r.parts, json.loads(r.body)) for r in account.account_export(hosts, sources, rules, events, part=10).collect()]
    assert sorted(e["id"] for h, _, b in docs if h == 1 for e in b.get("events", [])) == list(range(50)) and {p for h, p, _ in docs if h == 1} == {5}
    assert [b["rules"] for h, _, b in docs if "rules" in b] == [[{"source": 7, "level": "held"}]] and [h for h, *_ in docs].count(2) == 1
    rows = spark.range(600).select(F.lit(1).alias("source"), F.col("id").alias("position"), "id", F.lit(True).alias("readable"), F.lit("2024-01-15").cast("timestamp_ntz").alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"),
                                   F.lit("private").alias("privacy"), F.lit(None).cast("string").alias("join_url"), F.lit(None).cast("string").alias("image"), F.lit(True).alias("tz_inferred"))
    r = account.preview(rows, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).first()
    assert (r["count"], r.upcoming, r.cards, r.default_visibility) == (500, 500, list(range(60)), "held") and r.notes == ["no image", "marked private", "time zone assumed"]


def test_fresh(spark):
    rows = spark.createDataFrame([("2024-01-15 09:59:59",), ("2024-01-15 10:00:00",), (None,)], "at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert upkeep.fresh(rows, "preview", F.col("at"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).count() == 1
