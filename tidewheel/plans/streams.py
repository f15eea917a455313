"""Queries that run a stream over the given tables to its end, with the SQL twin of what it leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state, upsert
from .catalog import query


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # A pattern, since the stream source takes folders and patterns, not the name of one file.
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _stateful(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Rows of a stateful stream, run to its end with the state store that it needs."""
    place, key = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


@query("SELECT user_id AS source, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, d):
    place = scratch(spark)
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("source"), "ts", "event_id", "event_type")
    upsert.write(rows, f"{place}/table", f"{place}/state", ["source"], ["ts", "event_id"]).awaitTermination()
    return upsert.read(spark, f"{place}/table", ["source"], ["ts", "event_id"])


#: One step for each run of a source, in order: what it leaves of status, failures, unchanged runs, interval and last success.
_HEALTH = """WITH RECURSIVE l AS (SELECT user_id AS source, ts AS at_, event_id AS seq, event_type <> 'error' AS ok, event_type = 'purchase' AS changed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
w AS (SELECT source, CAST(0 AS BIGINT) AS nth, CAST(NULL AS TIMESTAMP) AS at_, CAST(NULL AS BIGINT) AS seq, 'active' AS status, 0 AS failures, 0 AS unchanged, CAST(3600 AS BIGINT) AS wait, CAST(NULL AS TIMESTAMP) AS good FROM (SELECT DISTINCT source FROM l)
  UNION ALL SELECT l.source, l.nth, l.at_, l.seq,
    CASE WHEN ok THEN CASE WHEN status = 'failing' THEN 'active' ELSE status END WHEN good IS NOT NULL AND l.at_ - good > INTERVAL 14 DAY THEN 'paused' WHEN failures + 1 >= 3 THEN 'failing' ELSE status END,
    CASE WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN NOT ok THEN unchanged WHEN changed OR unchanged + 1 >= 20 THEN 0 ELSE unchanged + 1 END,
    CASE WHEN NOT ok THEN least(86400, 3600 * CAST(pow(2, least(failures + 1, 6)) AS BIGINT)) WHEN changed THEN greatest(600, least(wait, 3600) // 2) WHEN unchanged + 1 >= 20 THEN least(21600, wait * 2) ELSE wait END,
    CASE WHEN ok THEN l.at_ ELSE good END FROM w JOIN l ON l.source = w.source AND l.nth = w.nth + 1)
SELECT source, at_ AS "at", seq, status, CAST(failures AS INTEGER) AS failures, CAST(unchanged AS INTEGER) AS unchanged, wait AS interval_s FROM w WHERE nth > 0"""


@query(_HEALTH)
def stream_health(spark, d):
    e = _stream(spark, d, "events")
    log = e.select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "purchase").alias("changed"))
    return _stateful(spark, state.intervals(log)).withColumn("at", F.col("at").cast("timestamp_ntz"))


_MISSING = """WITH RECURSIVE l AS (SELECT user_id % 20 AS source, event_type AS key, ts AS at_, event_id % 7 <> 0 AS complete, event_type IN ('click', 'view') AND event_id % 3 = 0 AS seen, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts) AS nth FROM events),
w AS (SELECT source, key, CAST(0 AS BIGINT) AS nth, CAST(NULL AS TIMESTAMP) AS at_, '' AS action, CAST(NULL AS TIMESTAMP) AS since, 0 AS runs, CAST(NULL AS TIMESTAMP) AS cancelled FROM (SELECT DISTINCT source, key FROM l)
  UNION ALL SELECT source, key, nth, at_, action, CASE WHEN seen THEN NULL WHEN action IN ('cancel', 'missing') THEN coalesce(since, at_) ELSE since END, CASE WHEN seen THEN 0 WHEN action IN ('cancel', 'missing') THEN runs + 1 ELSE runs END,
    CASE WHEN seen THEN NULL WHEN action = 'cancel' THEN at_ ELSE cancelled END
  FROM (SELECT l.*, since, runs, cancelled, CASE WHEN seen THEN CASE WHEN cancelled IS NULL THEN 'touch' ELSE 'update' END WHEN NOT complete THEN 'leave' WHEN cancelled IS NOT NULL THEN CASE WHEN l.at_ - cancelled > INTERVAL 7 DAY THEN 'remove' ELSE 'leave' END
    WHEN runs + 1 >= 2 AND l.at_ - coalesce(since, l.at_) >= INTERVAL 6 HOUR THEN 'cancel' ELSE 'missing' END AS action FROM w JOIN l ON l.source = w.source AND l.key = w.key AND l.nth = w.nth + 1))
SELECT source, key, at_ AS "at", action, CAST(runs AS INTEGER) AS missing_runs FROM w WHERE nth > 0"""


@query(_MISSING)
def stream_missing(spark, d):
    e = _stream(spark, d, "events")
    runs = e.select((F.col("user_id") % 20).alias("source"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 7 != 0).alias("complete"),
                    (F.col("event_type").isin("click", "view") & (F.col("event_id") % 3 == 0)).alias("seen"))
    return _stateful(spark, state.missing(runs)).withColumn("at", F.col("at").cast("timestamp_ntz"))


_KINDS = "CASE event_type WHEN 'purchase' THEN 'confirmation' WHEN 'view' THEN 'page' WHEN 'click' THEN 'preview' END"


@query(f"""WITH w AS (SELECT {_KINDS} AS kind, CAST(user_id AS VARCHAR) AS key, max(date_trunc('millisecond', ts)) AS "at" FROM events WHERE {_KINDS} IS NOT NULL GROUP BY ALL), n AS (SELECT max(date_trunc('millisecond', ts)) AS now FROM events WHERE {_KINDS} IS NOT NULL)
SELECT kind, key, "at" FROM w, n WHERE "at" + CASE kind WHEN 'page' THEN INTERVAL 7 DAY WHEN 'preview' THEN INTERVAL 2 HOUR ELSE INTERVAL 30 DAY END > now""")
def stream_lifetimes(spark, d):
    """Pages, previews and confirmations that are still kept when the stream has come to its end; all others have left the state."""
    kind = F.when(F.col("event_type") == "purchase", "confirmation").when(F.col("event_type") == "view", "page").when(F.col("event_type") == "click", "preview")
    writes = _stream(spark, d, "events").select(kind.alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at")).filter("kind is not null")
    return state.alive(_stateful(spark, state.lifetimes(writes))).withColumn("at", F.col("at").cast("timestamp_ntz"))
