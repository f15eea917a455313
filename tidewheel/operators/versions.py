"""Versions of a table by source: a commit rewrites the sources that changed, and readers see the last whole version.

A folder holds data/batch=.../bucket=... with the rows of the sources that one commit rewrote, and manifest/v=N with a row (source, batch) for each
source of version N.  A row counts if its source's batch is the one of the manifest.  The manifest is written last, and it is there once
Spark's committer has left its mark; so a commit that is broken off leaves files that no reader looks at.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a commit's rows are dealt to by their source.
BUCKETS = 64
MARK = "_SUCCESS"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions, rising."""
    found = [int(m[1]) for name in _children(spark, f"{folder}/manifest") if (m := re.fullmatch(r"v=(\d+)", name))]
    fs, _ = _files(spark, folder)
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/v={n}/{MARK}"))
    return sorted(n for n in found if there(n))


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest/v={version}")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless given.  Files of other sources' batches are pruned by their folders and the manifest."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no version in {folder}")
    live = manifest(spark, folder, known[-1] if version is None else version).withColumnRenamed("batch", "live_batch")
    batches = [r[0] for r in live.select("live_batch").distinct().collect()]  # a name for each commit since the last compact()
    rows = spark.read.option("basePath", f"{folder}/data").parquet(*(f"{folder}/data/batch={b}" for b in batches))
    kept = rows.join(live, (rows["source"].eqNullSafe(live["source"])) & (rows["batch"] == live["live_batch"]), "left_semi")
    return kept.drop("batch", "bucket")


def commit(rows: DataFrame, folder: str, changed: DataFrame | None = None) -> int:
    """Make the next version: rows of the sources in changed (source) replace these sources' rows, and all others stay as they are.

    Without changed all sources that rows has are replaced.  A changed source without rows is empty from then on.  Returns the
    version's number.  Of two commits at a time the second to write its manifest fails, and changes nothing.
    """
    spark = rows.sparkSession
    known = versions(spark, folder)
    number, batch = (known[-1] if known else 0) + 1, uuid.uuid4().hex
    # what a broken commit left of this number is no version
    fs, path = _files(spark, f"{folder}/manifest/v={number}")
    if fs.exists(path):
        fs.delete(path, True)
    changed = (rows if changed is None else changed).select("source").distinct()
    new = rows.join(changed.withColumnRenamed("source", "of"), rows["source"].eqNullSafe(F.col("of")), "left_semi")
    bucket = F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")
    new.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{folder}/data/batch={batch}")
    entries = changed.withColumn("batch", F.lit(batch))
    if known:
        old = manifest(spark, folder, known[-1])
        entries = entries.unionByName(old.join(changed.withColumnRenamed("source", "of"), old["source"].eqNullSafe(F.col("of")), "left_anti"))
    entries.write.parquet(f"{folder}/manifest/v={number}")
    return number


def compact(spark: SparkSession, folder: str) -> int:
    """A version with the rows of the last one in one batch, so that reads open few folders."""
    return commit(read(spark, folder), folder, manifest(spark, folder, versions(spark, folder)[-1]))


def expire(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all versions but the last `keep`, and the batches that none of these uses; the number of deleted batches.  Not to be run beside a commit."""
    known = versions(spark, folder)
    used = {r[0] for n in known[-keep:] for r in manifest(spark, folder, n).select("batch").distinct().collect()}
    fs, _ = _files(spark, folder)
    gone = [f"{folder}/manifest/v={n}" for n in known[:-keep]]
    old = [name for name in _children(spark, f"{folder}/data") if name.removeprefix("batch=") not in used]
    for name in [*gone, *(f"{folder}/data/{name}" for name in old)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), True)
    return len(old)
