"""Upsert of pushed rows: each batch keeps the latest of its keys, and readers take the latest over all batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMPACT_EVERY = 10


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _swap(spark: SparkSession, table: str, upto: int) -> None:
    """Put a finished compaction in place of the batches that it holds; may be repeated after a failure at any point."""
    fs, merged = _files(spark, f"{table}/_merged-{upto}")
    for n in range(upto + 1):
        fs.delete(_files(spark, f"{table}/batch={n}")[1], True)
    fs.rename(merged, _files(spark, f"{table}/batch={upto}")[1])


def compact(spark: SparkSession, table: str, upto: int, keys: list[str], order: list[str]) -> None:
    """Merge the batches 0 to `upto`, which no replay writes again, into one, so that readers don't read all that ever came."""
    fs, merged = _files(spark, f"{table}/_merged-{upto}")
    if not fs.exists(_files(spark, f"{table}/_merged-{upto}/_SUCCESS")[1]):
        old = spark.read.parquet(table).filter(F.col("batch") <= upto).drop("batch")
        latest(old, keys, order).write.mode("overwrite").parquet(merged.toString())
    _swap(spark, table, upto)


def write(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], digest: str | None = None, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start a stream that takes all there is and stops.

    A batch goes to a folder of its own, which a repeated batch overwrites, so that replays change nothing.  With a digest
    column, rows whose digest the table holds already are not written.  Before each `every`-th batch the earlier ones, which are committed, are
    merged; a merge that a failure cut off is finished first.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        cut = n - n % every - 1  # the batches up to the last multiple of `every`
        fs, merged = _files(spark, f"{table}/_merged-{cut}/_SUCCESS")
        if cut >= 0 and (n % every == 0 or fs.exists(merged)):
            compact(spark, table, cut, keys, order)
        new = latest(batch, keys, order)
        if digest and n:
            before = latest(spark.read.parquet(table).filter(F.col("batch") < n), keys, order).select(*keys, F.col(digest).alias("_old"))
            new = new.join(before, keys, "left").filter(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")
        new.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> DataFrame:
    return latest(spark.read.parquet(table).drop("batch"), keys, order)
