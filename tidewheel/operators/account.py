"""What a host is given: all that is kept of it, and a look at a source before it is connected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = 1000
SAMPLE, CARDS = 500, 60


def account_export(hosts: DataFrame, sources: DataFrame, rules: DataFrame, events: DataFrame, part: int = PART) -> DataFrame:
    """(host, part, parts, body): JSON documents of about `part` events, so that no document grows with a host.

    sources (host, source, ...) and rules (source, ...) go with part 0; a host without events has that part alone.
    """
    counts = events.groupBy("host").agg(F.ceil(F.count("*") / part).alias("parts"))
    heads = hosts.join(counts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    whole = lambda d: F.struct(*d.columns)
    owned = sources.groupBy("host").agg(F.collect_list(whole(sources)).alias("sources"))
    ruled = rules.join(sources.select("host", "source"), "source").groupBy("host").agg(F.collect_list(F.struct(*rules.columns)).alias("rules"))
    first = heads.join(owned, "host", "left").join(ruled, "host", "left").select("host", F.lit(0).cast("long").alias("part"), "sources", "rules")
    dealt = events.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    lists = dealt.groupBy("host", "part").agg(F.collect_list(whole(events)).alias("events"))
    full = lists.join(first, ["host", "part"], "full").join(heads, "host")
    body = F.to_json(F.struct(F.struct(*hosts.columns).alias("account"), "part", "parts", "sources", "rules", "events"))
    return full.select("host", "part", "parts", body.alias("body"))


def preview(rows: DataFrame, now: Column) -> DataFrame:
    """One row for each source, of its first SAMPLE rows by position: counts, signals, notes and the first CARDS upcoming ids.

    rows: source, position, id, readable, starts_at, ends_at, privacy, join_url, image, tz_inferred.  Upcoming: not over a day ago.
    """
    nth = F.row_number().over(W.partitionBy("source").orderBy("position", "id"))
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE)
    good, c = F.coalesce("readable", F.lit(False)), F.col
    ahead = good & F.coalesce(F.coalesce("ends_at", "starts_at") >= now - F.expr("interval 1 day"), F.lit(False))
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    out = first.groupBy("source").agg(
        count(good).alias("count"), count(~good).alias("dropped"), count(ahead).alias("upcoming"), count(good & c("privacy").isin("private", "confidential")).alias("private"),
        count(good & c("join_url").isNotNull()).alias("links"), count(ahead & c("image").isNull()).alias("no_image"), count(ahead & c("tz_inferred")).alias("inferred_tz"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(ahead, F.struct("nth", "id")))), lambda x: x["id"]), 1, CARDS).alias("cards"),
    )
    notes = F.array_compact(F.array(
        F.when(c("no_image") > 0, "no image"), F.when(c("private") > 0, "marked private"), F.when(c("links") > 0, "video link"),
        F.when((c("inferred_tz") > 0) & (c("inferred_tz") == c("upcoming")), "time zone assumed"), F.when(c("dropped") > 0, "unreadable"), F.when((c("upcoming") == 0) & (c("count") > 0), "all past"),
    ))
    held = (c("private") > 0) & (c("private") == c("count"))
    return out.select("*", notes.alias("notes"), F.when(held, "held").otherwise("public").alias("default_visibility"))
