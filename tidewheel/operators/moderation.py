"""Reports and their resolution, outage notices, withdrawal of sources, and checks of what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import is_conference

MOST_REPORTS = 200
ACTIONS = ("dismiss", "deindex", "takedown")


def report_queue(reports: DataFrame, events: DataFrame, hosts: DataFrame, everything: bool = False, most: int = MOST_REPORTS) -> DataFrame:
    """The newest open reports (report, uri, reason, created_at, resolved_at) with the event and host that they are about, if these exist."""
    wanted = reports if everything else reports.filter("resolved_at is null")
    about = events.filter("public_uri is not null").select(F.col("public_uri").alias("uri"), F.col("id").alias("event"), "host", "state", "visibility", "hidden")
    newest = wanted.orderBy(F.desc("created_at"), F.desc("report")).limit(most)
    return newest.join(about, "uri", "left").join(hosts.select("host", "handle"), "host", "left").select("report", "uri", "reason", "created_at", "event", "state", "visibility", "hidden", "handle")


def resolved(decisions: DataFrame, reports: DataFrame, events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(reports, overrides) after decisions (report, action, at).

    The first valid decision on an open report resolves it.  One that isn't a dismissal hides the report's event, and a takedown also asks for its
    record to be taken down: overrides (event, hidden_by, hidden_reason, takedown).
    """
    ok = decisions.filter(F.col("action").isin(*ACTIONS)).groupBy("report").agg(F.min_by("action", F.struct("at", "action")).alias("action"))
    both = reports.join(ok, "report", "left")
    new = F.col("resolved_at").isNull() & F.col("action").isNotNull()
    after = both.select(*(c for c in reports.columns if c not in ("resolved_at", "resolution")), F.when(new, now).otherwise(F.col("resolved_at")).alias("resolved_at"), F.when(new, F.col("action")).otherwise(F.col("resolution")).alias("resolution"))
    hit = both.filter(new & (F.col("action") != "dismiss")).join(events.select(F.col("public_uri").alias("uri"), F.col("id").alias("event")), "uri")
    hidden = hit.groupBy("event").agg(F.min_by("reason", "report").alias("hidden_reason"), F.bool_or(F.col("action") == "takedown").alias("takedown"))
    return after, hidden.select("event", F.lit("steward").alias("hidden_by"), "hidden_reason", "takedown")


def outage_notices(sources: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """(source, host, message) of failing sources without success for a day, once for each outage, to hosts with an address."""
    due = sources.filter((F.col("status") == "failing") & F.col("notified_at").isNull() & (F.col("last_success") < now - F.expr("interval 24 hours")))
    return due.join(hosts.filter("email is not null").select("host"), "host").select("source", "host", F.coalesce("last_error", F.lit("We could not read it.")).alias("message"))


def withdrawn(ledger: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, counts): the ledger without the rows of sources (source) that are taken away, and how many rows each of these had."""
    gone = sources.select("source").distinct()
    counts = gone.join(ledger.groupBy("source").agg(F.count("*").alias("removed")), "source", "left").select("source", F.coalesce("removed", F.lit(0).cast("long")).alias("removed"))
    return ledger.join(gone, "source", "left_anti"), counts


def teaser_leaks(events: DataFrame, records: DataFrame) -> DataFrame:
    """(id, street, link): live gated events to come whose public record (id, record) gives a street or a conference link away."""
    gated = events.filter("visibility = 'gated' and state = 'live' and public_uri is not null").select("id")
    body = F.from_json("record", "locations array<struct<street:string>>, uris array<struct<uri:string>>, description string").alias("r")
    street = F.exists(F.coalesce("r.locations", F.array().cast("array<struct<street:string>>")), lambda l: F.coalesce(l.street, F.lit("")) != "")
    call = F.exists(F.coalesce("r.uris", F.array().cast("array<struct<uri:string>>")), lambda u: F.coalesce(is_conference(u.uri), F.lit(False)))
    said = F.coalesce(F.col("r.description").rlike(r"(?i)https?://\S*(zoom\.us|meet\.google\.com|teams\.microsoft\.com)"), F.lit(False))
    return records.select("id", body).join(gated, "id").select("id", street.alias("street"), (call | said).alias("link")).filter("street or link")


def detail_record(country: str = "US") -> Column:
    """struct(exact_location, exact_pin, join_url): just what a gated event's public record leaves out; nulls where there is nothing."""
    c = F.col
    some = (F.coalesce("street", F.lit("")) != "") | (F.coalesce("venue", F.lit("")) != "")
    address = F.struct(c("venue").alias("name"), "street", "locality", "region", c("postal_code").alias("postalCode"), F.coalesce("country", F.lit(country)).alias("country"))
    pin = F.struct(c("lat").cast("string").alias("latitude"), c("lon").cast("string").alias("longitude"))
    return F.struct(F.when(some, address).alias("exact_location"), F.when(c("lat").isNotNull() & c("lon").isNotNull(), pin).alias("exact_pin"), F.nullif("join_url", F.lit("")).alias("join_url"))


def viewer_places() -> Column:
    """The row's `locations` as any viewer may see them: of gated events, and those that keep the place back, town and region only."""
    hide = F.coalesce(F.col("visibility") == "gated", F.lit(False)) | F.coalesce(F.array_contains("gated_fields", "exactLocation"), F.lit(False))
    none = F.lit(None).cast("string")
    return F.transform("locations", lambda l: F.struct(
        F.when(~hide, l["name"]).when(~F.coalesce(l.private, F.lit(False)), l.locality).alias("name"), F.when(~hide, l.street).otherwise(none).alias("street"), l.locality.alias("locality"), l.region.alias("region"), hide.alias("coarse"),
    ))


def last_runs(log: DataFrame, most: int = 10) -> DataFrame:
    """The newest `most` runs of each source, with their place from 1."""
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run")))
    return log.withColumn("nth", nth).filter(F.col("nth") <= most)


def newest(rows: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """The newest rows of a list, `most` at best."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(most)
