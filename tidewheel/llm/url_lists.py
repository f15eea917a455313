"""URL filtering against dated lists: validity intervals and an as-of join at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, small, staged

BUCKET_SECONDS, SALT_ROWS = 7 * 86400, 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a last dot; null without one."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def keys_of(url: Column) -> Column:
    """What a list may name to cover a url: itself without fragment, its host, and each domain above."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.array_join(F.slice(parts, j, F.size(parts)), "."))
    return F.when(host.isNotNull(), F.concat(F.array(F.regexp_replace(url, "#.*", "")), domains))


def intervals(entries: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """(key, since, until, listed): until is when the key's next entry takes effect, null if none.

    Entries (key, at, listed) say from when a key is listed or not.  Of entries at one time, listing wins.  A
    null key, time or verdict is no entry.  Successors are found inside time buckets first and then among the buckets'
    first entries, so that no key's whole history meets in one task.
    """
    clean = entries.filter("key is not null and at is not null and listed is not null").groupBy("key", "at").agg(F.max("listed").alias("listed"))
    cut = clean.withColumn("b", F.floor(F.unix_timestamp("at") / bucket))
    inner = cut.withColumn("until", F.lead("at").over(W.partitionBy("key", "b").orderBy("at")))
    firsts = cut.groupBy("key", "b").agg(F.min("at").alias("f"))
    after = firsts.select("key", "b", F.lead("f").over(W.partitionBy("key").orderBy("b")).alias("next"))
    return inner.join(after, ["key", "b"]).select("key", F.col("at").alias("since"), F.coalesce("until", "next").alias("until"), "listed")


def active(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """(url, at, n_lists, matched) for each distinct (url, at): the keys listed at that time.

    captures: (url, at).  Only keys that an entry names are looked up.  Captures and intervals of one key meet in time
    buckets: those of the bucket's own intervals, and the one that reaches in from before it; of the latter, each key needs one for each bucket
    that has captures.  In a bucket both are put in order of time and each capture takes the last interval that starts
    at or before it.  Buckets of a key with more than SALT_ROWS captures are split, and their intervals copied to each piece; so a
    key that holds a third of all rows is spread, whether its captures are spread over time or not.
    """
    asked = captures.filter("url is not null and at is not null").distinct()
    spans = staged(intervals(entries, bucket).withColumn("b", F.floor(F.unix_timestamp("since") / bucket)), "intervals")
    listed = small(staged(spans.select("key").distinct(), "keys"))
    keyed = asked.select("url", "at", F.explode(F.array_distinct(keys_of(F.col("url")))).alias("key")).join(listed, "key", "left_semi")
    keyed = staged(keyed.withColumn("b", F.floor(F.unix_timestamp("at") / bucket)), "asked")
    met = keyed.groupBy("key", "b").agg(F.count("*").alias("n"))
    interval = F.struct("since", "until", "listed")
    last = spans.groupBy("key", "b").agg(F.max(interval).alias("last")).withColumn("n", F.lit(None).cast("long"))
    before = W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    both = met.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)).unionByName(last).groupBy("key", "b").agg(F.max("n").alias("n"), F.max("last").alias("last"))
    reach = staged(both.withColumn("x", F.last("last", ignorenulls=True).over(before)).filter("n is not null").select("key", "b", "n", "x"), "reach")
    hot = small(staged(reach.filter(F.col("n") > SALT_ROWS).select("key", "b", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "hot"))
    rows = spans.select("key", "b", interval.alias("x")).join(reach.select("key", "b"), ["key", "b"], "left_semi").unionByName(reach.filter("x is not null").select("key", "b", "x"))
    rows = rows.join(hot, ["key", "b"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    rows = rows.select("key", "b", "salt", "x", F.col("x.since").alias("at"), F.lit(None).cast("string").alias("url"), F.lit(1).alias("entry"))
    salt = F.pmod(F.xxhash64("url", "at"), F.coalesce("salts", F.lit(1))).cast("int")
    asks = keyed.join(hot, ["key", "b"], "left").select("key", "b", salt.alias("salt"), F.lit(None).cast(rows.schema["x"].dataType).alias("x"), "at", "url", F.lit(0).alias("entry"))
    w = W.partitionBy("key", "b", "salt").orderBy("at", F.desc("entry")).rowsBetween(W.unboundedPreceding, 0)
    state = rows.unionByName(asks).withColumn("x", F.last("x", ignorenulls=True).over(w))
    state = state.filter((F.col("entry") == 0) & F.col("x.listed") & (F.col("x.until").isNull() | (F.col("at") < F.col("x.until"))))
    return state.groupBy("url", "at").agg(F.count("*").alias("n_lists"), F.max_by("key", F.struct(F.length("key"), "key")).alias("matched"))


def filtered(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """captures with blocked, n_lists and matched, the longest listed key (the greatest of equals).

    Rows without url or time, or whose url has no host, match nothing and aren't blocked; rows that repeat are each
    judged.  Where captures has a name of the new columns, in any case, the new one starts with underscores.
    """
    url, at, n, key, blocked, n_lists, matched = fresh(captures, "hit_url", "hit_at", "hit_n", "hit_key", "blocked", "n_lists", "matched")
    found = active(captures.select("url", "at"), entries, bucket).toDF(url, at, n, key)
    both = captures.join(found, (F.col("url") == F.col(url)) & (F.col("at") == F.col(at)), "left")
    return both.select(
        *(f"`{c}`" for c in captures.columns), F.col(url).isNotNull().alias(blocked), F.coalesce(n, F.lit(0)).cast("long").alias(n_lists), F.col(key).alias(matched)
    )


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that follows from its id, against a list that all pages feed.

    A page's report lists (even ids) or delists its host, its url, or its domain of the last three labels.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda step: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(page_id * {step} % 365 as int))")
    host = host_of(F.col("url"))
    key = F.when(F.col("page_id") % 3 == 0, host).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "#.*", "")).otherwise(F.substring_index(host, ".", -3))
    entries = pages.select(key.alias("key"), day(7919).alias("at"), (F.col("page_id") % 2 == 0).alias("listed"))
    out = filtered(pages.select("page_id", "url", day(104729).alias("at")), entries)
    return out.select("page_id", "blocked", "n_lists", "matched")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 104729 % 365 AS INTEGER)) AS t,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 365 AS INTEGER)) AS listed_at
  FROM pages),
e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(url, '#.*', '')
         ELSE array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') END AS key,
         listed_at AS t, bool_or(page_id % 2 = 0) AS listed
  FROM p GROUP BY 1, 2),
c AS (SELECT DISTINCT url, host, t FROM p),
k AS (
  SELECT url, t, regexp_replace(url, '#.*', '') AS key FROM c WHERE host IS NOT NULL
  UNION
  SELECT url, t, array_to_string(list_slice(string_split(host, '.'), j, len(string_split(host, '.'))), '.')
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS j FROM c WHERE host IS NOT NULL)),
m AS (
  SELECT k.url, k.t, k.key FROM k ASOF JOIN e ON k.key = e.key AND k.t >= e.t WHERE e.listed),
g AS (SELECT url, t, count(*) AS n, max(struct_pack(l := length(key), key := key)).key AS key FROM m GROUP BY 1, 2)
SELECT p.page_id, g.url IS NOT NULL AS blocked, coalesce(g.n, 0) AS n_lists, g.key AS matched
FROM p LEFT JOIN g ON p.url = g.url AND p.t = g.t
"""
