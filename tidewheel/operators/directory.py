"""Directory reads: guards, windows, pages, counts, places, buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.places import local_day

#: Bins of a histogram that looks for a rank.
BINS = 1024
PUBLIC_STATES, PUBLIC_LEVELS = ("live", "cancelled"), ("public", "gated")


def public(events: DataFrame) -> DataFrame:
    return events.filter(F.col("state").isin(*PUBLIC_STATES) & F.col("visibility").isin(*PUBLIC_LEVELS))


def window(events: DataFrame, now: Column, back_hours: int = 3, ahead_days: int = 120) -> DataFrame:
    return events.filter(F.col("starts_at").between(now - F.expr(f"interval {back_hours} hours"), now + F.expr(f"interval {ahead_days} days")))


def tagged(events: DataFrame, category: str) -> DataFrame:
    return events.filter((F.col("category") == category) | F.array_contains("tags", category))


def in_region(events: DataFrame, hosts: DataFrame, region: str) -> DataFrame:
    return events.join(hosts.filter(F.col("region") == region), "host")


def day_counts(events: DataFrame, zone: str) -> DataFrame:
    return events.groupBy(local_day(F.col("starts_at"), zone).alias("day")).agg(F.count("*").alias("n"))


def after(events: DataFrame, at: Column, key: Column) -> DataFrame:
    """Rows after (at, key) in (starts_at, id) order; the first half alone prunes files."""
    return events.filter((F.col("starts_at") >= at) & ((F.col("starts_at") > at) | (F.col("id") > key)))


def page(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy("starts_at", "id").limit(limit)


def state_counts(events: DataFrame, now: Column) -> DataFrame:
    """Live, cancelled and held rows of each source that start after yesterday; sources without any have zeros."""
    recent = F.col("starts_at") > now - F.expr("interval 1 day")
    return events.groupBy("source").agg(*(F.count_if(recent & (F.col("state") == s)).alias(s) for s in ("live", "cancelled", "held")))


def digest(events: DataFrame, now: Column) -> DataFrame:
    new = F.count_if((F.col("starts_at") > now - F.expr("interval 31 days")) & (F.col("starts_at") <= now)).alias("new_rows")
    upcoming = F.count_if((F.col("starts_at") > now) & (F.col("state") == "live")).alias("upcoming")
    return events.groupBy("host").agg(new, upcoming).filter("new_rows > 0 or upcoming > 0")


def stats(events: DataFrame, now: Column) -> DataFrame:
    live = (F.col("state") == "live") & (F.col("starts_at") > now)
    return events.agg(F.countDistinct("host").alias("hosts"), F.count_if(live).alias("upcoming"), F.count_if(live & F.col("has_image")).alias("with_image"), F.max(F.when(F.col("starts_at") <= now, F.col("starts_at"))).alias("latest"))


def places(events: DataFrame) -> DataFrame:
    return events.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(
        F.count("*").alias("n"), F.min("starts_at").alias("first_start"), F.min_by("id", F.struct("starts_at", "id")).alias("first_id")
    )


def quantiles(rows: DataFrame, wanted: dict[str, tuple[str, Callable[[int], int]]], bins: int = BINS) -> dict[str, float | None]:
    """The value of a rank in a column, for each name in wanted: (column, rank from 1 of the number of values, without nulls and NaN); None without values.

    Histograms of `bins` bins between bounds, those of all names in one pass, tell which bin holds the rank; its least and greatest value are the next
    bounds, until they are one value.  A pass narrows the bounds `bins` times or more, so there are few, whatever the rows or
    how dense they lie, and no values are sorted or shuffled.  Only bins, `bins` a name at most, come to the driver.
    """
    columns = sorted({c for c, _ in wanted.values()})
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    ends = rows.agg(*(f(number(c)).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("low", F.min), ("high", F.max)))).first()
    out: dict[str, float | None] = {}
    left = {}
    for name, (c, rank) in wanted.items():
        n, low, high = (ends[f"{k}_{c}"] for k in ("n", "low", "high"))
        if not n or low == high:
            out[name] = low
        else:
            left[name] = (c, rank(n), low, high)
    while left:
        def entry(name: str, c: str, low: float, high: float):
            v = number(c)
            at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
            return F.when(v.between(low, high), F.struct(F.lit(name).alias("name"), at.alias("bin"), v.alias("v")))

        each = rows.select(F.explode(F.array_compact(F.array(*(entry(name, c, low, high) for name, (c, _, low, high) in left.items())))).alias("e")).select("e.*")
        found = each.groupBy("name", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for name in list(left):
            c, rank, *_ = left.pop(name)
            for r in sorted((r for r in found if r["name"] == name), key=lambda r: r["bin"]):
                if rank <= r["n"]:
                    if r["low"] == r["high"]:
                        out[name] = r["low"]
                    else:
                        left[name] = (c, rank, r["low"], r["high"])
                    break
                rank -= r["n"]
    return out


def map_frame(events: DataFrame, pad: float = 0.01, low: float = 0.05, high: float = 0.95, least: int = 20) -> DataFrame:
    """One row of nearest-rank percentiles of both axes, widened by pad; plain bounds below `least` points, nulls without any."""
    rank = lambda q: lambda n: (1 if q < 0.5 else n) if n < least else int(q * (n - 1)) + 1
    found = quantiles(events, {f"{axis}_{side}": (axis, rank(q)) for axis in ("lat", "lon") for side, q in (("min", low), ("max", high))})
    row = {name: None if v is None else v + (-pad if name.endswith("min") else pad) for name, v in found.items()}
    names = [f"{axis}_{side}" for axis in ("lat", "lon") for side in ("min", "max")]
    return events.sparkSession.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} double" for n in names))


def bucket(at: Column, now: Column, zone: str) -> Column:
    """tonight, weekend, week or later by local days; the first that holds."""
    day, today = local_day(at, zone), local_day(now, zone)
    monday = F.date_sub(today, F.weekday(today))
    return (
        F.when(day == today, "tonight")
        .when(day.between(F.date_add(monday, 4), F.date_add(monday, 6)) & (day >= today), "weekend")
        .when((day > today) & (day <= F.date_add(today, 7)), "week")
        .when(day > today, "later")
        .otherwise("past")
    )


def month_grid(counts: DataFrame, month: str) -> DataFrame:
    """42 cells from the Monday on or before the first of the month, with each day's count."""
    first = F.to_date(F.lit(month))
    start = F.date_sub(first, F.weekday(first))
    cells = counts.sparkSession.range(42).select(F.date_add(start, F.col("id").cast("int")).alias("day"))
    return cells.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), (F.month("day") == F.month(first)).alias("in_month"))


def week_strip(counts: DataFrame, first: str) -> DataFrame:
    week = counts.filter(F.col("day").between(F.to_date(F.lit(first)), F.date_add(F.to_date(F.lit(first)), 6)))
    most = F.max("n").over(W.partitionBy())
    return week.select("day", "n", F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(12), F.round(100 * F.col("n") / most).cast("int"))).alias("bar"))


def day_cells(events: DataFrame, zone: str, top: int = 3) -> DataFrame:
    """The first `top` rows of each local day, and how many more there are."""
    days = events.withColumn("day", local_day(F.col("starts_at"), zone))
    ranked = days.withColumn("place", F.row_number().over(W.partitionBy("day").orderBy("starts_at", "id"))).filter(F.col("place") <= top)
    total = days.groupBy("day").agg(F.count("*").alias("total"))
    return ranked.join(total, "day").select("day", "place", "id", F.greatest(F.col("total") - top, F.lit(0)).alias("more"))
