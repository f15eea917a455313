"""Who may see an event: rules, source signals and overrides; queues and audits that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How visible each level is.
RANK = {"public": 5, "unlisted": 4, "gated": 3, "members": 2, "invite": 1, "held": 0}


def rank(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), level)


CONDITIONS = ["title_contains", "calendar", "category", "location_type", "flag"]
#: Letters of a title's phrase that an index entry has.
GRAM = 3
#: Rows and bytes up to which an index is sent to every task.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def place_type(mode: Column, has_private_place: Column) -> Column:
    """online, home or venue, as rules name the kind of an event's place."""
    return F.when(mode == "virtual", "online").when(has_private_place, "home").otherwise("venue")


def flags(privacy: Column, join_url: Column) -> Column:
    """The flags that rules may ask for and that an event has."""
    return F.array_compact(F.array(F.when(privacy.isin("private", "confidential"), "private"), F.when(privacy == "unlisted", "membersOnly"), F.when(F.coalesce(join_url, F.lit("")) != "", "conference")))


def _grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda p: F.substring(text, p, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))


def _rule_keys() -> Column:
    """Entries that an event must have for the rule to match it: one for each condition but the title, which has one for each gram."""
    low, one = F.lower("title_contains"), lambda c: F.array_compact(F.array(c))
    title = F.when(F.length(low) >= GRAM, _grams(low, GRAM)).when(low.isNotNull(), F.array(low))
    sized = F.transform(title, lambda g: F.concat(F.lit("title"), F.length(g).cast("string"), F.lit(":"), g))
    rest = (_named("calendar", one(F.lower("calendar"))), _named("category", one(F.lower("category"))), _named("place", one(F.col("location_type"))), _named("flag", one(F.col("flag"))))
    return F.array_distinct(F.concat(F.coalesce(sized, F.array().cast("array<string>")), *rest))


def _event_keys(sizes: list[int]) -> Column:
    name = F.lower("name")
    grams = [_named(f"title{n}", _grams(name, n)) for n in sizes]
    rest = (
        _named("calendar", F.array_compact(F.array(F.lower("calendar")))), _named("category", F.array_compact(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lower("category")))),
        _named("place", F.array("place_type")), _named("flag", F.col("flags")),
    )
    return F.array_distinct(F.concat(*grams, *rest))


def standing(rules: DataFrame) -> DataFrame:
    """Rules that can decide anything: the first of each host with the same conditions, and none behind a rule without conditions.

    An empty condition counts as none, and an unknown location type or flag matches nothing, as no event has one.
    """
    blank = {c: F.when(F.col(c) != "", F.col(c)) for c in CONDITIONS if c in rules.columns} | {c: F.lit(None).cast("string") for c in CONDITIONS if c not in rules.columns}
    more = {} if "gated_fields" in rules.columns else {"gated_fields": F.lit(None).cast("array<string>")}
    clean = rules.withColumns(blank | more)
    same = ["host", F.lower("title_contains").alias("t"), F.lower("calendar").alias("c"), "category", "location_type", "flag"]
    first = clean.groupBy(*same).agg(F.min_by(F.struct(*clean.columns), "position").alias("r")).select("r.*")
    bare = F.coalesce(*CONDITIONS).isNull()
    last = first.filter(bare).groupBy(F.col("host").alias("of")).agg(F.min("position").alias("end"))
    kept = first.join(last, F.col("host").eqNullSafe(F.col("of")), "left").filter(F.col("end").isNull() | (F.col("position") <= F.col("end")))
    return kept.select(*clean.columns)


def rule_index(rules: DataFrame, events: DataFrame) -> DataFrame:
    """(host, entry, position, conditions): each standing rule under that of its entries which fewest events of its host have.

    events have host and keys.  Rules without a condition have a null entry.
    """
    entries = rules.select("host", "position", F.explode(_rule_keys()).alias("entry"))
    wanted = entries.select("host", "entry").distinct()
    have = _spread(wanted, events.select("host", F.explode("keys").alias("entry")))
    counts = have.groupBy("host", "entry").agg(F.count("*").alias("n"))
    rated = entries.join(counts, ["host", "entry"], "left")
    best = rated.groupBy("host", "position").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry")).alias("b"))
    # no event of the host has the rarest entry of a rule with n = 0
    live = best.filter("b.n > 0").select("host", "position", F.col("b.entry").alias("entry"))
    bare = rules.filter(F.coalesce(*CONDITIONS).isNull()).select("host", "position", F.lit(None).cast("string").alias("entry"))
    return rules.join(live.unionByName(bare), ["host", "position"])


def _spread(index: DataFrame, keyed: DataFrame) -> DataFrame:
    """keyed rows that have a (host, entry) of index; rows of other entries go before anything is shuffled if the entries are few."""
    return keyed.join(_sized(index.select("host", "entry").distinct()), ["host", "entry"], "left_semi")


def _sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are few and short, by a count of both."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else df


def matches() -> Column:
    """Whether a rule's conditions hold for an event's name, calendar, category, tags, place_type and flags; a missing one always does."""
    r = lambda c: F.col(f"r.{c}")
    met = lambda given, ok: given.isNull() | F.coalesce(ok, F.lit(False))
    return (
        met(r("title_contains"), F.contains(F.lower("name"), F.lower(r("title_contains")))) & met(r("calendar"), F.lower("calendar") == F.lower(r("calendar")))
        & met(r("category"), (F.col("category") == r("category")) | F.coalesce(F.array_contains("tags", F.lower(r("category"))), F.lit(False)))
        & met(r("location_type"), F.col("place_type") == r("location_type")) & met(r("flag"), F.array_contains("flags", r("flag")))
    )


def first_rule(events: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """events with rule_level, rule_audience, rule_fields and rule_position of their host's first rule that matches, or nulls.

    events: name, category, tags, and as far as they are there host, calendar, place_type and flags.  rules: position, level, audience, and as far as
    they are there host, gated_fields and CONDITIONS, of which nulls match anything.  Without host all events are of one host.

    Rules are found by an index: each is entered under its rarest condition, or three letters of its title's phrase, so that an event meets only
    those rules of its host that it shares such an entry with, and these are checked.  Events without rules aren't touched.
    """
    missing = {"host": F.lit(0).cast("long"), "calendar": F.lit(None).cast("string"), "place_type": F.lit(None).cast("string"), "flags": F.array().cast("array<string>")}
    by_host = "host" in rules.columns
    rules = standing(rules if by_host else rules.withColumn("host", missing["host"]))
    full = events.withColumns({c: v for c, v in missing.items() if c not in events.columns or (c == "host" and not by_host)})
    sizes = [r[0] for r in rules.select(F.least(F.length("title_contains"), F.lit(GRAM)).alias("n")).filter("n is not null").distinct().collect()]
    keyed = full.select(F.col(key).alias("key_"), "host", "name", "calendar", "category", "tags", "place_type", "flags").withColumn("keys", F.coalesce(_event_keys(sizes), F.array().cast("array<string>")))
    found = rule_index(rules, keyed)
    bare, with_entry = found.filter("entry is null"), found.filter("entry is not null")
    r = F.struct("position", "level", "audience", "gated_fields", *CONDITIONS).alias("r")
    met = keyed.withColumn("entry", F.explode("keys")).drop("keys")
    met = _spread(with_entry, met).join(_sized(with_entry.select("host", "entry", r)), ["host", "entry"]).filter(matches())
    plain = F.struct("r.position", "r.level", "r.audience", "r.gated_fields")
    hits = met.groupBy("key_").agg(F.min_by(plain, "r.position").alias("hit"))
    last = bare.select(F.col("host").alias("of_host"), F.struct("position", "level", "audience", "gated_fields").alias("last"))
    out = full.join(hits, F.col(key) == F.col("key_"), "left").join(_sized(last), F.col("host") == F.col("of_host"), "left")
    # the rule without conditions stands behind all others that count
    rule = F.coalesce("hit", "last")
    return out.select(*events.columns, rule.level.alias("rule_level"), rule.audience.alias("rule_audience"), rule.gated_fields.alias("rule_fields"), rule.position.alias("rule_position"))


def classify(events: DataFrame, default: str | Column, default_audience: Column | None = None, in_space: Column | None = None) -> DataFrame:
    """events with visibility, visibility_source, audience and gated_fields.

    Needs rule_level and rule_audience (first_rule), privacy, join_url, has_private_place, override_level, override_hidden; rule_fields,
    override_audience and override_fields count where they are there.  The first rule replaces the source's default; a private or unlisted mark
    caps it; an override replaces it up to the cap; hidden holds it.  A private event of a source that is mapped to a space (in_space) goes to that source's
    members or invited, if these are its default and it has an audience.  Levels for an audience without one are held.
    """
    text, fields_type = F.lit(None).cast("string"), "array<string>"
    get = lambda name, kind="string": F.col(name) if name in events.columns else F.lit(None).cast(kind)
    default = F.lit(default) if isinstance(default, str) else default
    own = default_audience if default_audience is not None else text
    to_space = F.coalesce((in_space if in_space is not None else F.lit(False)) & own.isNotNull() & default.isin("members", "invite"), F.lit(False))
    cap = F.when(F.col("privacy").isin("private", "confidential"), F.when(to_space, default).otherwise("held")).when(F.col("privacy") == "unlisted", "unlisted")
    base = F.coalesce("rule_level", default)
    capped = F.coalesce(rank(cap) < rank(base), F.lit(False))
    too_high = F.coalesce(rank(F.col("override_level")) > rank(cap), F.lit(False))
    given = F.col("override_level").isNotNull()
    chosen, hidden = given & ~too_high, F.coalesce("override_hidden", F.lit(False))
    level = F.when(hidden, "held").when(chosen, F.col("override_level")).when(capped, cap).otherwise(base)
    source = (
        F.when(hidden | chosen, "per-event").when(capped, "source-signal")
        .when(F.col("rule_level").isNotNull(), "rule").otherwise("host-default")
    )
    audience = F.coalesce(F.when(given, get("override_audience")), "rule_audience", own)
    none = F.array().cast(fields_type)
    signs = F.array_compact(F.array(F.when(F.coalesce("join_url", F.lit("")) != "", "joinUrl"), F.when(F.col("has_private_place"), "exactLocation")))
    fields = F.array_distinct(F.concat(signs, F.coalesce(get("rule_fields", fields_type), none), F.coalesce(F.when(given, get("override_fields", fields_type)), none)))
    out = events.withColumns({"level0": level, "visibility_source": source, "audience0": audience})
    for_some = F.col("level0").isin("members", "invite")
    gated = F.when((F.col("level0") == "gated") & (F.size(fields) == 0), F.array(F.lit("exactLocation"))).otherwise(fields)
    return out.withColumns({
        "gated_fields": gated, "visibility": F.when(for_some & F.col("audience0").isNull(), "held").otherwise(F.col("level0")), "audience": F.when(for_some, F.col("audience0")),
    }).drop("level0", "audience0")


def widen_queue(planned: DataFrame, open_items: DataFrame) -> DataFrame:
    """Events that wait for leave and aren't in the queue yet, once each."""
    return planned.filter("action = 'widen-pending'").select("source", "key").distinct().join(open_items, ["source", "key"], "left_anti")


def leaks(events: DataFrame) -> DataFrame:
    """Rows that only some may see but that have a public address."""
    return events.filter(F.col("visibility").isin("members", "invite", "held") & F.col("public_uri").isNotNull())


def privacy_violations(texts: DataFrame, text: Column) -> DataFrame:
    from ..functions.text import EMAIL, PHONE

    return texts.filter(text.rlike(EMAIL) | text.rlike(PHONE) | F.contains(text, F.lit("ATTENDEE")))


def policy(tree: dict, depth: int = 8) -> Column:
    """A policy tree as one predicate over flag columns.

    {"any": [...]}, {"all": [...]}, {"role": n} (role of n or more), or {"flag": column}.  An empty list and a missing
    flag are false; a tree deeper than `depth` is an error.
    """
    if depth < 1:
        raise ValueError("policy is too deep")
    if "any" in tree or "all" in tree:
        parts = [policy(x, depth - 1) for x in tree.get("any", tree.get("all"))]
        out = parts[0] if parts else F.lit(False)
        for x in parts[1:]:
            out = out | x if "any" in tree else out & x
        return out
    if "role" in tree:
        return F.coalesce(F.col("role") >= tree["role"], F.lit(False))
    return F.coalesce(F.col(tree["flag"]), F.lit(False))


GATED_DETAIL = {"any": [{"flag": "confirmed"}, {"flag": "authority"}, {"role": 20}]}
INVITED = {"any": [{"flag": "invited"}, {"flag": "shared"}, {"role": 10}]}


def members(least: int) -> dict:
    return {"role": least}


def redeem(redemptions: DataFrame, invites: DataFrame) -> DataFrame:
    """(invite, person, role, used): who gets in by an invite: first uses in order up to max_uses, while it is valid."""
    first = redemptions.groupBy("invite", "person").agg(F.min("at").alias("at"))
    ok = first.join(invites, "invite").filter(~F.col("revoked") & (F.col("at") < F.col("expires")))
    nth = F.row_number().over(W.partitionBy("invite").orderBy("at", "person"))
    return ok.withColumn("used", nth).filter(F.col("used") <= F.col("max_uses")).select("invite", "person", "role", "used")


def request_states(log: DataFrame, now: Column, stale_days: int = 30) -> DataFrame:
    """(space, person, state): the last state of each request; a pending one that is too old is denied."""
    last = log.groupBy("space", "person").agg(F.max_by(F.struct("state", "at"), F.struct("at", "seq")).alias("r"))
    stale = (F.col("r.state") == "pending") & (F.col("r.at") < now - F.expr(f"interval {stale_days} days"))
    return last.select("space", "person", F.when(stale, "denied").otherwise(F.col("r.state")).alias("state"))
