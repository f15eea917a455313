"""Changes that hosts make by hand: overrides of events, and answers to what waits for leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import rank

WAITS_DAYS = 30
OVERRIDE = ["hidden", "category", "image", "gated_fields", "audience"]


def patch(events: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(overrides, queue) of events (id, source, visibility, override) and one patch each (id, OVERRIDE, clear_image, visibility).

    override is a struct of OVERRIDE, level and allow_widen_to.  Nulls in a patch change nothing.  A level that shows less
    takes effect and ends an earlier leave to widen; one that shows more becomes an item of the queue.
    """
    rows = events.alias("e").join(patches.alias("p"), "id")
    old, to = lambda n: F.col(f"e.override.{n}"), F.col("p.visibility")
    wider = F.coalesce(rank(to) > rank(F.col("e.visibility")), F.lit(False))
    now_level = to.isNotNull() & ~wider
    new = {n: F.coalesce(F.col(f"p.{n}"), old(n)) for n in OVERRIDE}
    new["image"] = F.when(F.coalesce("p.clear_image", F.lit(False)), None).otherwise(new["image"])
    new |= {"level": F.when(now_level, to).otherwise(old("level")), "allow_widen_to": F.when(~now_level, old("allow_widen_to"))}
    queue = rows.filter(wider).select("id", "e.source", F.lit("widen").alias("kind"), F.col("e.visibility").alias("from"), to.alias("to"), (now + F.expr(f"interval {WAITS_DAYS} days")).alias("expires_at"))
    return rows.select("id", F.struct(*(c.alias(n) for n, c in new.items())).alias("override")), queue


def outcomes(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions (item, host, action) with the item's columns and outcome: confirmed, rejected, not-found or already-resolved."""
    known = items.withColumn("_known", F.lit(True))
    out = F.when(F.col("_known").isNull(), "not-found").when(F.col("resolved_at").isNotNull(), "already-resolved").when(F.col("action") == "reject", "rejected").otherwise("confirmed")
    return decisions.join(known, ["item", "host"], "left").withColumn("outcome", out).drop("_known")


def extracted(resolved: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows to push of confirmed items (extracted: array of structs with external_id and name); edits (item, external_id, some
    of their fields) replace what they give, and rows without a name go."""
    rows = resolved.filter("outcome = 'confirmed' AND kind = 'extracted'").select("item", "host", F.explode("extracted").alias("x")).select("item", "host", "x.*")
    both = rows.alias("r").join(edits.alias("e"), ["item", "external_id"], "left")
    given = set(edits.columns) - {"item", "external_id"}
    out = both.select(*(F.coalesce(f"e.{c}", f"r.{c}").alias(c) if c in given else F.col(c) for c in rows.columns))
    return out.filter(F.btrim("name") != "")


def widened(resolved: DataFrame, events: DataFrame) -> DataFrame:
    """(id, level, allow_widen_to) of events (id, host, override) with leave: the level is set unless it came from the source's default."""
    got = resolved.filter("outcome = 'confirmed' AND kind = 'widen'").select("host", F.col("event").alias("id"), "to", "source_default")
    level = F.when(F.col("source_default").isNull(), F.col("to")).otherwise(F.col("override.level"))
    return events.join(got, ["host", "id"]).select("id", level.alias("level"), F.col("to").alias("allow_widen_to"))
