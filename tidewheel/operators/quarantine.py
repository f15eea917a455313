"""Rows that can't be used: set aside with a reason, and counted, in the pass that keeps the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) of rows with `given`, the columns as they came, and `reason`, null for those that are kept."""
    return judged.filter("reason is null").drop("given", "reason"), judged.filter("reason is not null").select("given.*", "reason")


def settle(judged: DataFrame, folder: str, reasons: list[str]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept, refused, counts): as split(), but both are written under folder in one pass, and counts say how many rows had each reason, "" for those kept."""
    seen = Observation()
    counts = [F.count_if(F.col("reason") == r).alias(f"n_{n}") for n, r in enumerate(reasons)]
    watched = judged.observe(seen, F.count_if(F.col("reason").isNull()).alias("kept"), *counts)
    watched.withColumn("refused", F.col("reason").isNotNull()).write.partitionBy("refused").parquet(folder)
    found = judged.sparkSession.read.schema(judged.schema.add("refused", "boolean")).parquet(folder)
    got = seen.get
    kept, refused = (found.filter(F.col("refused") == flag).drop("refused") for flag in (False, True))
    return split(kept)[0], split(refused)[1], {"": got["kept"]} | {r: got[f"n_{n}"] for n, r in enumerate(reasons)}
