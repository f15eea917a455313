"""Test views: calendar-shaped tables derived from the given ones, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-15 12:00:00"
ZONE = "America/Denver"
NAMES = ["music", "arts", "food", "civic", "tech", "film", "family", "sports", "markets", "wellness"]
LEVELS = ["public", "gated", "unlisted", "members", "invite", "held"]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event row for each row of events."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    state = F.when(F.col("event_type").isin("click", "view"), "live").when(F.col("event_type") == "purchase", "cancelled").when(F.col("event_type") == "signup", "held").otherwise("removed")
    return e.select(
        n.alias("id"), (F.col("user_id") % 20).alias("source"), (F.col("user_id") % 25).alias("host"), n.cast("string").alias("external_id"),
        F.col("ts").alias("starts_at"),
        F.when(n % 5 != 0, F.col("ts") + F.make_dt_interval(hours=(n % 5).cast("int"))).alias("ends_at"),
        state.alias("state"), pick(LEVELS, n % 6).alias("visibility"), pick(NAMES, n % 10).alias("category"),
        F.array(pick(NAMES, (n + 3) % 10), pick(NAMES, (n + 7) % 10)).alias("tags"),
        (39.5 + (n * 7919 % 1000) / 1000.0).alias("lat"), (-105.8 + (n * 104729 % 1000) / 1000.0).alias("lon"),
        (n % 3).alias("missing_runs"), (n % 7 != 0).alias("has_image"),
    )


def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("host"), F.col("r_name").alias("region"))


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Two fetches of the order book: each misses a tenth of the keys, and the new one has changed prices."""
    o = table(spark, sf_dir, "orders")
    n, price = F.col("o_orderkey"), F.col("o_totalprice")
    rank = n % (4 if new else 6)
    return o.filter(n % 10 != (1 if new else 0)).select(
        (F.col("o_custkey") % 20).alias("source"), n.alias("key"),
        (F.when(n % 10 == 2, price + 1).otherwise(price) if new else price).alias("price"),
        (rank if new else F.lit(5) - rank).cast("int").alias("level"),
        F.col("o_orderdate").alias("starts_at"), F.when(n % 4 != 0, F.col("o_orderdate") + F.make_dt_interval((n % 4).cast("int"))).alias("ends_at"), F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("order of "), F.col("o_custkey")).alias("title"),
    )


LEDGER = f"""
ledger AS (
  SELECT event_id AS id, user_id % 20 AS source, user_id % 25 AS host, CAST(event_id AS VARCHAR) AS external_id, ts AS starts_at,
    CASE WHEN event_id % 5 <> 0 THEN ts + to_hours(CAST(event_id % 5 AS INTEGER)) END AS ends_at,
    CASE WHEN event_type IN ('click', 'view') THEN 'live' WHEN event_type = 'purchase' THEN 'cancelled' WHEN event_type = 'signup' THEN 'held' ELSE 'removed' END AS state,
    {LEVELS}[CAST(event_id % 6 + 1 AS INTEGER)] AS visibility, {NAMES}[CAST(event_id % 10 + 1 AS INTEGER)] AS category,
    [{NAMES}[CAST((event_id + 3) % 10 + 1 AS INTEGER)], {NAMES}[CAST((event_id + 7) % 10 + 1 AS INTEGER)]] AS tags,
    39.5 + (event_id * 7919 % 1000) / 1000.0::DOUBLE AS lat, -105.8 + (event_id * 104729 % 1000) / 1000.0::DOUBLE AS lon,
    event_id % 3 AS missing_runs, event_id % 7 <> 0 AS has_image
  FROM events),
host AS (SELECT CAST(n_nationkey AS BIGINT) AS host, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
"""

SNAPS = """
snap_old AS (
  SELECT o_custkey % 20 AS source, o_orderkey AS key, o_totalprice AS price, CAST(5 - o_orderkey % 6 AS INTEGER) AS level, o_orderdate AS starts_at, o_orderstatus AS status,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) END AS ends_at, 'order of ' || o_custkey AS title
  FROM orders WHERE o_orderkey % 10 <> 0),
snap_new AS (
  SELECT o_custkey % 20 AS source, o_orderkey AS key, CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
    CAST(o_orderkey % 4 AS INTEGER) AS level, o_orderdate AS starts_at, o_orderstatus AS status,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) END AS ends_at, 'order of ' || o_custkey AS title
  FROM orders WHERE o_orderkey % 10 <> 1)
"""
