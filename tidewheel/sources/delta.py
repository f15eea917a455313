"""Reads that list only what changed since a token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api

EXPIRED = 410


def google(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw rows with source, fetch, complete; fetches) of answers (source, fetch, page, token, status, payload).

    An answer to a request with a token lists changes, one without token lists all.  Once a token has expired in a fetch,
    its answers to the token don't count and the full read does.  A fetch with any other failure gives no rows.
    fetches: source, fetch, complete, failed, cursor (the token for the next fetch, or the old one if none came).
    """
    ok = F.col("status") == 200
    fetches = pages.groupBy("source", "fetch").agg(
        F.bool_or(F.col("status") == EXPIRED).alias("expired"), F.bool_or(~F.col("status").isin(200, EXPIRED)).alias("failed"), F.max("token").alias("token0"),
        F.max_by(F.get_json_object("payload", "$.nextSyncToken"), F.when(ok, F.col("page"))).alias("next"),
    ).select("source", "fetch", "expired", "failed", (F.col("expired") | F.col("token0").isNull()).alias("complete"), F.coalesce("next", "token0").alias("cursor"))
    read = pages.join(fetches, ["source", "fetch"]).filter(ok & ~F.col("failed") & (~F.col("expired") | F.col("token").isNull()))
    return api.google(read, ("source", "fetch", "complete")), fetches.drop("expired")
