"""Retention and source health from the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retained(rows: DataFrame, at: Column, now: Column, days: int) -> DataFrame:
    return rows.filter(at >= now - F.expr(f"interval {days} days"))


# How long pages, previews and confirmations are kept.
LIFETIME = {"page": "7 days", "preview": "2 hours", "confirmation": "30 days"}


def fresh(rows: DataFrame, kind: str, at: Column, now: Column) -> DataFrame:
    """Cached rows of a kind that haven't outlived it; a row without a time has."""
    return rows.filter(at >= now - F.expr(f"interval {LIFETIME[kind]}"))


def health(log: DataFrame, now: Column) -> DataFrame:
    """(source, status, failures, unchanged) after the last run of log (source, at, seq, ok, changed): failing from three failures, paused after 14 days without success.

    failures and unchanged count the runs after the last success, and after the last change or failure, which one aggregation finds and another counts
    from; so no source's log is sorted, and a long one is spread over tasks.
    """
    at, breaks = F.struct("at", "seq"), F.col("changed") | ~F.col("ok")
    last = log.groupBy("source").agg(F.max(F.when(F.col("ok"), at)).alias("good"), F.max(F.when(breaks, at)).alias("broke"))
    since = lambda mark: F.coalesce(at > F.col(mark), F.lit(True))
    counts = log.join(last, "source").groupBy("source").agg(
        F.count_if(~F.col("ok") & since("good")).alias("failures"), F.count_if(F.col("ok") & ~F.col("changed") & since("broke")).alias("unchanged"), F.max("good.at").alias("good_at"),
    )
    stale = F.col("good_at").isNull() | (F.col("good_at") < now - F.expr("interval 14 days"))
    status = F.when(stale, "paused").when(F.col("failures") >= 3, "failing").otherwise("ok")
    return counts.select("source", status.alias("status"), "failures", "unchanged")
