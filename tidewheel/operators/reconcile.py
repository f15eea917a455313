"""Reconcile a snapshot with the ledger: one full outer join and one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_title
from .versions import commit

#: Keys in a bucket of create_budget().
BUCKET = 1 << 16


def content_hash(*cols: str) -> Column:
    """Hash of the values by name as JSON; a null differs from an empty text, and no value runs into the next."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def decide_missing(complete: Column, ended: Column, in_window: Column, state: Column, cancelled_days: Column, runs: Column, hours: Column, least_runs: int = 2, least_hours: int = 6, keep_days: int = 7) -> Column:
    """What happens to a ledger row that the snapshot lacks."""
    old = (state == "cancelled") & F.coalesce(cancelled_days > keep_days, F.lit(False))
    return (
        F.when(~complete, "leave")
        .when(old & (state == "cancelled"), "remove")
        .when(ended | ~in_window | (state == "cancelled"), "leave")
        .when((runs + 1 >= least_runs) & (hours >= least_hours), "cancel")
        .otherwise("missing")
    )


def reconciled(ledger: DataFrame, snapshot: DataFrame, now: Column, complete: Column | None = None, window: tuple[Column, Column] | None = None) -> DataFrame:
    """(source, key, action, new_key, l, s) for each row of either side: l and s are the sides' rows, and s of a rekeyed row is the one with its new key.

    Both sides have source, key, level (higher is more visible), hash, title, starts_at and ends_at; the ledger also state,
    published, from_signal, widen_to, missing_runs, missing_hours, cancelled_days.  A row that gets more visible without leave waits,
    whatever else changed, if it is published, held, or as visible as its source said, and also where any of this is unknown; a removed one comes back as a new
    one; an unchanged one that isn't cancelled is only touched.  Rows of a source that came back under new keys, with the same normalized title and
    start (churn()), are given these.  complete may use the column source.

    The sides meet in one full outer join.  Rekeyed rows are found among the rows that it leaves alone, and marked by a join that keeps its partitions.
    """
    keys = ["source", "key"]
    complete = F.lit(True) if complete is None else complete
    titled = lambda d: d.withColumn("title_norm", norm_title(F.col("title")))
    met = _met(ledger, snapshot)
    narrow = _met(titled(ledger).select(*keys, "title_norm", "starts_at", "state"), titled(snapshot).select(*keys, "title_norm", "starts_at", *(c for c in snapshot.columns if c not in (*keys, "starts_at"))))
    pairs = _pairs(narrow, ["title_norm", "starts_at"], complete & F.coalesce(F.col("l.state") != "removed", F.lit(True)))
    marks = pairs.select("source", F.explode(F.array(
        F.struct(F.col("old_key").alias("key"), F.col("fresh.key").alias("new_key"), F.col("fresh").alias("s_new"), F.lit(True).alias("old")),
        F.struct(F.col("fresh.key").alias("key"), F.lit(None).cast(snapshot.schema["key"].dataType).alias("new_key"), F.lit(None).cast(pairs.schema["fresh"].dataType).alias("s_new"), F.lit(False).alias("old")),
    )).alias("m")).select("source", "m.*")
    # an old row and a fresh one never share a key, so there is one mark for each
    both = met.join(marks, keys, "left").filter(F.coalesce("old", F.lit(True)))
    fields = [c for c in snapshot.columns if c not in keys]
    both = both.withColumn("s", F.when(F.col("old"), F.struct(F.col("new_key").alias("key"), F.col("source").alias("source"), *(F.col(f"s_new.{c}").alias(c) for c in fields))).otherwise(
        F.when(F.col("s").isNotNull(), F.struct(F.col("key").alias("key"), F.col("source").alias("source"), *(F.col(f"s.{c}").alias(c) for c in fields)))))
    here, there = F.col("l").isNotNull(), F.col("s").isNotNull()
    unless = lambda ok: F.coalesce(ok, F.lit(True))
    guarded = unless(F.col("l.published")) | unless(F.col("l.state") == "held") | unless(F.col("l.from_signal"))
    widens = unless(F.col("s.level") > F.col("l.level")) & guarded & unless(F.col("l.widen_to") < F.col("s.level"))
    same = (F.col("l.level") == F.col("s.level")) & (F.col("l.hash") == F.col("s.hash")) & (F.col("l.state") != "cancelled")
    inside = F.lit(True) if window is None else F.col("l.starts_at").between(*window)
    ended = F.coalesce("l.ends_at", "l.starts_at") < now
    gone = decide_missing(complete, ended, inside, F.col("l.state"), F.col("l.cancelled_days"), F.col("l.missing_runs"), F.col("l.missing_hours"))
    action = (
        F.when(F.col("old"), "rekey").when(~here, "create").when(~there & (F.col("l.state") == "removed"), None).when(~there, gone)
        .when(widens, "widen-pending").when(F.col("l.state") == "removed", "create").when(same, "touch").otherwise("update")
    )
    return both.select(*keys, action.alias("action"), "new_key", "l", "s")


def plan(ledger: DataFrame, snapshot: DataFrame, now: Column, complete: Column | None = None, window: tuple[Column, Column] | None = None) -> DataFrame:
    """(source, key, action, new_key) of reconciled(), new_key only for rekey, without the removed rows that stay so."""
    return reconciled(ledger, snapshot, now, complete, window).filter("action is not null").select("source", "key", "action", "new_key")


def _met(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(source, key, l, s) of the full outer join; l and s are null where a side lacks the key."""
    keys = ["source", "key"]
    packed = lambda d, name: d.select(*keys, F.struct(*(c for c in d.columns if c not in keys)).alias(name))
    return packed(ledger, "l").join(packed(snapshot, "s"), keys, "full_outer")


def _pairs(met: DataFrame, by: list[str], counts: Column, least: int = 5, share: float = 0.8) -> DataFrame:
    """(source, old_key, fresh) of rows that stand alone on either side: see churn().  counts: which of the missing rows count."""
    alone = met.filter((F.col("l").isNull() != F.col("s").isNull()) & (F.col("l").isNull() | counts))
    lost, found = F.col("s").isNull(), F.col("l").isNull()
    value = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(f"s.{c}")).alias(c)
    rest = [c for c in met.schema["s"].dataType.names if c not in by]
    grouped = alone.withColumns({f"by_{c}": value(c) for c in by}).groupBy("source", *(f"by_{c}" for c in by)).agg(
        F.count_if(lost).alias("m"), F.count_if(found).alias("f"), F.max(F.when(lost, F.col("key"))).alias("old_key"),
        F.min_by(F.struct("key", *(F.col(f"s.{c}").alias(c) for c in [*by, *rest])), F.when(found, F.col("key"))).alias("fresh"),
    )
    real = F.lit(True)
    for c in by:
        real &= F.col(f"by_{c}").isNotNull()
    pair = F.col("old_key").isNotNull() & F.col("fresh").isNotNull() & real
    sums = grouped.groupBy("source").agg(F.sum("m").alias("m"), F.sum("f").alias("f"), F.count_if(pair).alias("p"))
    ok = sums.filter((F.col("m") >= least) & (F.col("f") >= least) & (F.col("p") >= F.ceil(share * F.col("f")))).select("source")
    return grouped.filter(pair & (F.col("m") > 0) & (F.col("f") > 0)).join(ok, "source", "left_semi").select("source", "old_key", "fresh")


def churn(missing: DataFrame, fresh: DataFrame, by: list[str], least: int = 5, share: float = 0.8) -> DataFrame:
    """(source, old_key, new_key): rows of a source that came back under new keys.

    At most one pair for each value of `by`, the greatest missing key with the least new one, if a source has at least `least` on
    both sides and pairs for `share` of the new ones.  Rows with a null in `by` are no pair.
    """
    side = lambda d, name, other: d.select("source", "key", F.struct(*by).alias(name), F.lit(None).cast(d.select(F.struct(*by)).schema[0].dataType).alias(other))
    alone = side(missing, "l", "s").unionByName(side(fresh, "s", "l"))
    return _pairs(alone, by, F.lit(True), least, share).select("source", "old_key", F.col("fresh.key").alias("new_key"))


# How visible a level is at least where it has a public record, and at most where it has one for guests.
PUBLIC_LEAST, GUESTS = 3, (1, 3)


def applied(decided: DataFrame, now: Column) -> DataFrame:
    """The next version of the ledger from reconciled() rows, with what each row's change takes back; no join is needed.

    The ledger's rows also have public_uri, own (its host wrote the public record: taken over, and
    never deleted), space_uri, missing_since, missing_runs, cancelled_at, last_seen; the snapshot's cancelled and
    own_uri.  withdrawn: public and guests' records to delete.
    """
    rest = [c for c in decided.schema["l"].dataType.names if c not in ("source", "key")]
    rows = decided.select("source", "key", F.coalesce("new_key", "key").alias("at_key"), "action", "s", *(F.col(f"l.{c}").alias(c) for c in rest))
    a, c = F.coalesce("action", F.lit("leave")), F.col
    take, seen = a.isin("create", "update", "rekey"), a.isin("create", "update", "rekey", "touch", "widen-pending")
    held, was_out = take & (c("s.level") == 0), c("public_uri").isNotNull() | c("space_uri").isNotNull()
    cleared = seen | ((a == "cancel") & was_out)
    new = lambda name: F.when(take, c(f"s.{name}")).otherwise(c(name))
    own = F.coalesce(F.when(take, c("s.own_uri").isNotNull()).otherwise(c("own")), F.lit(False))
    public = F.when(take, F.when(c("s.level") >= PUBLIC_LEAST, F.coalesce("s.own_uri", "public_uri", F.concat(F.lit("at://"), "source", F.lit("/"), "at_key")))).when(a != "remove", c("public_uri"))
    space = F.when(take, F.when(c("s.level").between(*GUESTS), F.concat(F.lit("space://"), "source", F.lit("/"), "at_key"))).when(a != "remove", c("space_uri"))
    state = F.when(held, "held").when(take, F.when(c("s.cancelled"), "cancelled").otherwise("live")).when(a == "cancel", "cancelled").when(a == "remove", "removed").otherwise(c("state"))
    ended = F.when(a.isin("update", "rekey") & ~held, F.when(c("s.cancelled"), F.coalesce("cancelled_at", now))).when(a == "cancel", now).otherwise(c("cancelled_at"))
    out = rows.select(
        "source", F.when(take, c("at_key")).otherwise(c("key")).alias("key"), *(new(n).alias(n) for n in ("level", "hash", "title", "starts_at", "ends_at")), state.alias("state"),
        public.alias("public_uri"), space.alias("space_uri"),
        F.when(~cleared, F.when(a == "missing", F.coalesce("missing_since", now)).otherwise(c("missing_since"))).alias("missing_since"),
        F.when(cleared, 0).otherwise(F.coalesce("missing_runs", F.lit(0)) + (a == "missing").cast("int")).cast("int").alias("missing_runs"),
        ended.alias("cancelled_at"), F.when(cleared, now).otherwise(c("last_seen")).alias("last_seen"), c("public_uri").alias("old_public"), c("space_uri").alias("old_space"),
        (take & (c("level") != c("s.level"))).alias("moved"), own.alias("own"),
    )
    gone = F.array_compact(F.array(
        F.when(c("old_public").isNotNull() & c("public_uri").isNull() & ~c("own"), c("old_public")),
        F.when(c("old_space").isNotNull() & (c("space_uri").isNull() | c("moved")), c("old_space")),
    ))
    return out.withColumn("withdrawn", gone).drop("old_public", "old_space", "moved")


def write(version: DataFrame, decided: DataFrame, folder: str) -> int:
    """Commit the next version of a ledger for the sources of reconciled() rows in which anything but last_seen changes; see versions.commit()."""
    changed = decided.filter("action not in ('touch', 'leave')").select("source").distinct()
    return commit(version.drop("withdrawn"), folder, changed)


def run_counters(planned: DataFrame) -> DataFrame:
    names = ("create", "update", "touch", "rekey", "widen-pending", "cancel", "missing", "remove", "leave")
    return planned.groupBy("source").agg(*(F.count_if(F.col("action") == n).alias(n.replace("-", "_")) for n in names))


def create_budget(planned: DataFrame, order: list[str], budget: int = 250) -> DataFrame:
    """Creates of each source in order, those beyond the budget put off to the next run.

    Ranks are found in buckets of keys first, so that no source is sorted as a whole: within a bucket by a window, before it by running
    sums of the buckets' counts.  `order` is one number that rises with the place.
    """
    (key,) = order
    creates = planned.filter("action = 'create'").withColumn("_b", F.floor(F.col(key) / BUCKET))
    inner = creates.withColumn("_r", F.row_number().over(W.partitionBy("source", "_b").orderBy(key)))
    sizes = creates.groupBy("source", "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("source").orderBy("_b")) - F.col("_n")).drop("_n")
    nth = (F.col("_r") + F.col("_before")).cast("int")
    return inner.join(before, ["source", "_b"]).withColumn("nth", nth).drop("_b", "_r", "_before").withColumn("deferred", F.col("nth") > budget)


def push_results(pushed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source, key, result) of what became of pushed rows (source, key, level, hash): created, held, updated or unchanged, by the ledger's hashes before."""
    was = ledger.select("source", "key", F.struct("hash").alias("was"))
    result = F.when(F.col("was").isNull(), "created").when(F.col("level") == 0, "held").when(~F.col("hash").eqNullSafe(F.col("was.hash")), "updated").otherwise("unchanged")
    return pushed.join(was, ["source", "key"], "left").select("source", "key", result.alias("result"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Last write wins for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def pushed(calls: DataFrame) -> DataFrame:
    """The rows that pushed calls (source, external_id, at, seq, deleted, status, ...) leave: the last write of each key wins.

    A delete keeps what the last write said and sets a tombstone, which reads as a cancelled event; a later write clears it.  A delete of a key
    that was never written leaves nothing.
    """
    keys = ["source", "external_id"]
    rest = [c for c in calls.columns if c not in (*keys, "at", "seq", "deleted")]
    order = F.struct("at", "seq")
    last = calls.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.when(~F.col("deleted"), order)).alias("r"), F.max_by("deleted", order).alias("gone")).filter("r is not null")
    return last.select(*keys, *(F.when(F.col("gone"), "cancelled").otherwise(F.col("r.status")).alias(c) if c == "status" else F.col(f"r.{c}") for c in rest))
