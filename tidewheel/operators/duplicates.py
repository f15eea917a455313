"""Group listings of one event across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rounds import cut

LEAST_TITLE, LEAST_RATIO = 12, 0.75


def url_groups(items: DataFrame) -> DataFrame:
    """(url, day, title, first) of the first item by (starts_at, id) with each URL; items have id, url, day, title, starts_at."""
    lead = F.min_by(F.struct("day", "title", "starts_at", "id"), F.struct("starts_at", "id")).alias("r")
    return items.groupBy(F.lower("url").alias("url")).agg(lead).select("url", "r.*")


def leads(items: DataFrame) -> DataFrame:
    """(day, title, o) of the distinct listings: o is the first item's (starts_at, id)."""
    return url_groups(items).groupBy("day", "title").agg(F.min(F.struct("starts_at", "id")).alias("o"))


def alike(first: DataFrame) -> DataFrame:
    """(later, earlier) for each two titles of a day of which one begins the other and has LEAST_RATIO of its length, by their order o.

    first: (day, title, o).  A title is looked up by its own beginnings of those lengths, a quarter of its letters, so that no two titles
    are compared that aren't alike.
    """
    long = first.filter(F.length("title") > LEAST_TITLE)
    size = F.length("title")
    low = F.greatest(F.lit(LEAST_TITLE + 1), F.ceil(LEAST_RATIO * size).cast("int"))
    cuts = F.when(low < size, F.transform(F.sequence(low, F.greatest(low, size - 1)), lambda n: F.substring("title", F.lit(1), n)))
    begins = long.select("day", F.col("o").alias("whole"), F.explode(cuts).alias("title"))
    pairs = begins.join(long.select("day", "title", F.col("o").alias("part")), ["day", "title"])
    return pairs.select(F.greatest("whole", "part").alias("later"), F.least("whole", "part").alias("earlier"))


def openers(first: DataFrame) -> DataFrame:
    """(o, opener) of each title: the title that opened the group it goes to, itself if it opens one.

    In order of o a title goes to the first group whose opening title it is alike to, or else opens one; titles that join a group open none.  This is
    found in rounds: a title opens a group once all earlier ones that it is alike to are known not to, and doesn't once one of them is known to.  A round joins
    the titles still open with what is known of their earlier ones; it takes as many rounds as the longest chain of titles that wait for each other.
    """
    edges = cut(alike(first))
    waiting = edges.select("later").distinct()
    opens = first.filter(F.length("title") > LEAST_TITLE).select("o").join(waiting, F.col("o") == F.col("later"), "left_anti").withColumn("opens", F.lit(True))
    known, left = cut(opens), edges
    while True:
        seen = left.join(known.select(F.col("o").alias("earlier"), "opens"), "earlier", "left")
        state = seen.groupBy("later").agg(F.max(F.coalesce("opens", F.lit(False))).alias("some"), F.count_if(F.col("opens").isNull()).alias("unknown"))
        told = cut(state.filter("some or unknown = 0").select(F.col("later").alias("o"), (~F.col("some")).alias("opens")))
        if told.isEmpty():
            break
        known = cut(known.unionByName(told))
        left = cut(left.join(told.select(F.col("o").alias("later")), "later", "left_anti"))
    by_opener = edges.join(known.filter("opens").select(F.col("o").alias("earlier")), "earlier", "left_semi").groupBy(F.col("later").alias("o")).agg(F.min("earlier").alias("opener"))
    closed = known.filter("not opens").select("o").join(by_opener, "o")
    return first.select("o").join(closed, "o", "left").select("o", F.coalesce("opener", "o").alias("opener"))


def groups(items: DataFrame) -> DataFrame:
    """(id, group_id): listings of one event, named by the first item in order of (starts_at, id).

    Items with one URL are one listing; listings with one day and title are one group; those of a day whose long titles begin
    alike join the first such group (openers()).
    """
    first = cut(leads(items))
    of_title = first.join(openers(first), "o").select("day", "title", F.col("opener.id").alias("group_id"))
    of_url = url_groups(items).join(of_title, ["day", "title"]).select("url", "group_id")
    return items.select("id", F.lower("url").alias("url")).join(of_url, "url").select("id", "group_id")


def prefix_links(items: DataFrame) -> DataFrame:
    """(group_id, into): the first item of each day and title that joins another title's group, and that group."""
    return leads(items).select(F.col("o.id").alias("id")).join(groups(items), "id").filter("id <> group_id").select(F.col("id").alias("group_id"), F.col("group_id").alias("into"))


def collapse(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, primary_id, n, also_on): the best-ranked item of each group and the other URLs, once each."""
    all_ = items.join(groups, "id")
    nth = F.row_number().over(W.partitionBy("group_id").orderBy("rank", "published_at", "id"))
    first = all_.withColumn("nth", nth).filter("nth = 1").select("group_id", F.col("id").alias("primary_id"), F.lower("url").alias("own"))
    other = all_.groupBy("group_id").agg(F.count("*").alias("n"), F.collect_set(F.lower("url")).alias("urls"))
    return first.join(other, "group_id").select("group_id", "primary_id", "n", (F.size(F.array_remove("urls", F.col("own")))).cast("long").alias("also_on"))
