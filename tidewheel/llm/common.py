"""Shared folder, row keys and connected components for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def fits(df: DataFrame) -> bool:
    """Whether a staged table has at most BROADCAST_ROWS rows, and these at most BROADCAST_BYTES bytes as JSON text."""
    if df.count() > BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A staged table with a broadcast hint if it fits(); else a shuffle joins it."""
    return F.broadcast(df) if fits(df) else df


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later read needs."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def _row_key(i: Column, t: Column) -> Column:
    """A hash that tells rows of one id apart; its last bit says that the id is missing."""
    return F.xxhash64(i, t).bitwiseAND(F.lit(-2)).bitwiseOR(i.isNull().cast("long"))


def missing_id(k: Column | str = "k") -> Column:
    """1 where text_rows() found no id, else 0."""
    return (F.col(k) if isinstance(k, str) else k).bitwiseAND(F.lit(1).cast("long"))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(i, k, text): i orders documents (a missing id comes last), k tells rows of one id apart and holds whether the id is missing.

    Rows that agree in id and text share both, and get the same results.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(F.coalesce(i, F.lit(NO_ID)).cast("long").alias("i"), _row_key(i, t).alias("k"), t.alias("text"), *(c.alias(name) for name, c in more.items()))


def id_out(i: str = "i", lost: Column | str = "k") -> Column:
    """The id that text_rows() ordered by, missing again where it was missing."""
    return F.when((F.col(i) != NO_ID) | (missing_id(lost) == 0), F.col(i))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the two key columns of text_rows() under free names."""
    ni, nk = fresh(docs, "row_i", "row_k")
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.withColumns({ni: F.coalesce(i, F.lit(NO_ID)).cast("long"), nk: _row_key(i, t)}), ni, nk


def with_key(docs: DataFrame, found: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join docs, whatever columns they have, with found, a row for each (i, k)."""
    left, ni, nk = keyed(docs, id_col, text_col)
    ren = found.withColumnsRenamed({"i": ni, "k": nk})
    return left.join(ren, [ni, nk], how).drop(ni, nk)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): label is the least node that is reachable.

    Each round takes the least label among neighbours and then jumps to the label's label, so that
    rounds grow with the logarithm of the longest chain.  Nothing but a count reaches the driver.
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(now.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        step = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = now.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = staged(step.join(up, "mid").select("node", F.least("mid", "top").alias("label"), "old"), "labels")
        changed = new.filter(F.col("label") != F.col("old")).limit(1).count()
        discard(now)
        now = new
        if not changed:
            discard(both)
            path = new._staged_path
            out = new.select("node", "label")
            out._staged_path = path
            return out
