"""Merkle manifest of a table: trees of nodes labelled by the leaves they cover, proofs, and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, staged

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: binary, right: binary>>"


def digest(*parts: Column) -> Column:
    """sha256 of the parts laid end to end; those that are digests go in as lowercase hex.  The result is 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(value: Column) -> Column:
    """Digests, one or more after another, as lowercase hex."""
    return F.lower(F.hex(value))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and the value, or - if it is null."""
    text = lambda c: c.cast("string")
    return digest(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")).cast("binary") for c in fields))


def _placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows sorted by ranges of (group, order) with their range and place; and (part, of, base, n), a row for each range and group.

    base + place is a row's rank in its group, n the rows of the group.  So no group is sorted or counted in one task.
    """
    place = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    place = staged(place.withColumn("part", F.shiftright("at", 33)), "placed")
    counts = place.groupBy(F.col(group).alias("of"), "part").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    own = W.partitionBy("of")
    base = F.sum("m").over(own.orderBy("part")) - F.col("m") - F.col("first")
    return place, staged(counts.select("of", "part", base.alias("base"), F.sum("m").over(own).alias("n")), "bases")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with tree (the rank of their group; null first, then by bytes), n (rows of the group) and rank (from 0 in it, by order)."""
    place, base = _placed(rows, group, order)
    heads, first = _placed(base.select("of", F.lit(0).alias("top")).distinct(), "top", ["of"])
    named = heads.join(small(first.select("part", "base")), "part").select(F.col("of").alias("named"), (F.col("at") + F.col("base")).alias("tree"))
    base = staged(base.join(named, F.col("of").eqNullSafe(F.col("named"))).drop("named"), "bases")
    base = small(base.withColumnRenamed("part", "in_part"))
    out = place.join(base, (F.col("part") == F.col("in_part")) & F.col(group).eqNullSafe(F.col("of")))
    return out.withColumn("rank", F.col("at") + F.col("base")).drop("at", "part", "in_part", "of", "base")


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees of leaves (tree, n, lo, hi, digest, ...), from the leaves up; a level lacks the trees that end below it.

    Every FAN consecutive nodes become one, with the interval of leaf ranks that they cover and their own labels as `children`.  A
    group has FAN rows at most, whatever the size of a tree.
    """
    levels, span = [leaves], 1
    most = leaves.agg(F.max("n")).first()[0] or 0
    while span < most:
        wide = span * FAN
        below = levels[-1].filter(F.col("n") > span).groupBy("tree", "n", F.floor(F.col("lo") / wide).alias("bucket"))
        nodes = below.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        joined = F.aggregate("children", F.lit(b""), lambda a, c: F.concat(a, c.digest))
        ends = F.get("children", F.lit(0))["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi")
        levels.append(staged(nodes.select("tree", "n", *ends, digest(shown(joined).cast("binary")).alias("digest"), "children"), "level"))
        span = wide
    return levels


def with_paths(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with `path` (what stands left and right of a node at each level, from the leaf up) and the columns of their tree's top.

    tops: (tree, path, *carried), the path of each tree's root onwards.  From the root down, nodes join the level above by the bucket of
    their interval, keep the parent whose interval contains theirs, and take the parent's other children, those outside their own
    interval, as siblings.
    """
    above, tops = None, small(tops)
    for level in range(len(levels) - 1, -1, -1):
        span, nodes = FAN**level, levels[level]
        here = nodes.filter(F.col("n") <= span).join(tops, "tree").select(*nodes.columns, "path", *carried)
        if above is not None:
            up = above.select(*(F.col(c).alias(f"up_{c}") for c in ("tree", "lo", "hi", "children", "path")), *carried)
            bucket = F.floor(F.col("lo") / (span * FAN)) == F.floor(F.col("up_lo") / (span * FAN))
            inside = (F.col("tree") == F.col("up_tree")) & bucket & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
            side = lambda ok: F.aggregate(F.filter("up_children", ok), F.lit(b""), lambda a, c: F.concat(a, c.digest))
            step = F.struct(side(lambda c: c.hi < F.col("lo")).alias("left"), side(lambda c: c.lo > F.col("hi")).alias("right"))
            below = nodes.filter(F.col("n") > span).join(up, inside)
            here = here.unionByName(below.select(*nodes.columns, F.concat(F.array(step), "up_path").alias("path"), *carried))
        if not level:
            return here
        above = staged(here, "paths")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda a, s: digest(shown(F.concat(s.left, a, s.right)).cast("binary")))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, left to right, as one."""
    return F.aggregate(path, F.lit(b""), lambda a, s: F.concat(a, s.left, s.right))


def manifest(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes) of rows that hold `leaf`, the digest of a row.

    There is a tree for each group over its leaves by order, and one over the groups' roots by group, null first, then by bytes.  leaves: rows
    with tree, path, subroot and root.  nodes: (tree, level, lo, hi, digest) of all trees; tree is the rank of the group, -1 for the one on
    top.  A tree of one leaf is that leaf.  An empty table has neither leaves nor nodes.  A null in `order` comes first; of rows with one order the lesser
    digest does, and equal rows are leaves each.  rows must not have columns named tree, n, rank, lo, hi, digest, path, subroot or root.

    A level takes one grouping and one join of its nodes, an eighth of those below, by keys of eight rows at most; so work and disk
    are in proportion to the rows, and a path to their logarithm.
    """
    at = F.col("rank")
    leaves = staged(ranked(rows, group, [*order, "leaf"]).withColumnsRenamed({"leaf": "digest"}).withColumns({"lo": at, "hi": at}).drop("rank"), "leaves")
    levels = grown(leaves)
    whole = "lo = 0 AND hi = n - 1"
    roots = levels[0].filter(whole).select("tree", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter(whole).select("tree", "digest"))
    roots = staged(roots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("lo"), F.col("tree").alias("hi"), "digest"), "roots")
    upper = grown(roots.withColumn("n", F.lit(roots.count()).cast("long")))
    root = staged(upper[-1].select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root")), "root")
    tops = with_paths(upper, root, ["root"]).select(F.col("lo").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    out = with_paths(levels, staged(tops, "tops"), ["subroot", "root"])
    parts = [level.select("tree", F.lit(at).alias("level"), "lo", "hi", "digest") for found in (levels, upper) for at, level in enumerate(found)]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return out.drop("n", "lo", "hi").withColumnRenamed("digest", "leaf"), nodes


def checked(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", tamper: tuple[Column, dict[str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): the order column, leaf, subroot, root, path and folded_root of each row of docs, and the manifest's nodes.

    folded_root is what the row's leaf gives with the siblings of the manifest; `tamper`, a condition and changed fields, changes rows after the
    manifest was made, as a test of the check.  Columns of docs beside `fields` don't count.  Null fields have a mark of their own, so that a
    null isn't an empty text.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    when, changed = tamper or (F.lit(False), {})
    rows = docs.select(
        F.col(f"`{group}`").cast("string").alias("of_group"), F.col(f"`{order}`").alias("of_order"), leaf_digest(list(cols.values())).alias("leaf"),
        F.when(when, leaf_digest([changed.get(c, cols[c]) for c in fields])).alias("now"),
    )
    leaves, nodes = manifest(rows, "of_group", ["of_order"])
    return leaves.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path"))).withColumnRenamed("of_order", order), nodes


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows, _ = checked(spark.read.parquet(f"{sf_dir}/documents.parquet"), tamper=(third, {"text": lower}))
    hexed = [shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select(
        "doc_id", *hexed, F.sha2(shown(proof(F.col("path"))).cast("binary"), 256).alias("proof_sha256"), shown(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified")
    )
