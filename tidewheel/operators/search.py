"""Ranked keyword search over an inverted index held as a table."""

from __future__ import annotations

from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.places import near
from ..functions.text import ACCENTED, PLAIN, excerpt
from .cards import HIDDEN_PLACE, is_coarse
from .directory import PUBLIC_LEVELS, PUBLIC_STATES, public
from .duplicates import collapse, groups
from .rounds import cut

#: What parts words: all but letters, digits and marks of any script.  Scripts without spaces have a word for each character.
APART, ALONE = r"[^\p{L}\p{N}\p{M}]+", r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"
DESCRIPTION_MOST, MOST_HITS = 2000, 500
# Words that carry no signal, and what people type for what.
STOPS = ["the", "a", "an", "and", "of", "at", "in", "on", "for", "to", "with", "by", "from"]
SYNONYMS = {
    "kids": ["family", "children", "youth", "kid"], "family": ["kids", "children", "youth"], "children": ["kids", "family", "youth"], "youth": ["kids", "teen", "teens"],
    "talk": ["lecture", "panel", "discussion", "speaker"], "lecture": ["talk", "panel", "discussion"], "panel": ["talk", "lecture", "discussion"], "discussion": ["talk", "panel", "conversation"],
    "gig": ["concert", "show", "live music"], "concert": ["gig", "show", "live music"], "show": ["concert", "gig", "performance"], "live music": ["concert", "gig", "show"], "performance": ["show", "concert"],
    "volunteer": ["service", "workday", "work day", "stewardship"], "workday": ["volunteer", "service", "work day"], "work day": ["volunteer", "workday"], "service": ["volunteer", "stewardship"],
    "farmers market": ["market", "farmer market", "farmers"], "market": ["farmers market", "marketplace"], "farmer market": ["farmers market", "market"],
    "class": ["workshop", "course", "training", "lesson"], "workshop": ["class", "course", "training"], "course": ["class", "workshop", "training"], "training": ["class", "workshop", "course"],
    "meetup": ["meet-up", "meet up", "gathering", "social"], "meet-up": ["meetup", "meet up", "gathering"], "meet up": ["meetup", "meet-up"], "gathering": ["meetup", "social", "circle"],
    "hike": ["walk", "trail", "hiking"], "walk": ["hike", "stroll"], "potluck": ["dinner", "meal", "supper"], "repair": ["fix", "repair cafe", "mend"], "yoga": ["movement", "stretch"], "free": ["no cost", "donation"],
}


def index(docs: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, attribute, position, token): attributes count from 0 in order of weight; tokens are words in lower case without accents."""
    each = F.posexplode(F.array(*(F.coalesce(F.col(a), F.lit("")) for a in attributes))).alias("attribute", "text")
    words = docs.select("id", each).select("id", "attribute", F.posexplode(F.split(F.regexp_replace(folded(F.col("text")), ALONE, " $1 "), APART)).alias("position", "token"))
    return words.filter((F.col("token") != "") & ~F.col("token").isin(*STOPS))


def folded(text: Column) -> Column:
    """Lower case without accents, those of single letters and combining ones."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[\u0300-\u036f]", "")


def refreshed(entries: DataFrame, changed: DataFrame, attributes: list[str]) -> DataFrame:
    """The index after some documents changed: their old entries go and new ones come; a document whose attributes are all null has none.  No other document is read."""
    return entries.join(changed.select("id").distinct(), "id", "left_anti").unionByName(index(changed, attributes))


def tokens(text: str) -> list[str]:
    """Words of a query or synonym, parted as the index parts texts."""
    plain = regex.sub("[\u0300-\u036f]", "", text.lower().translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])))
    return [w for w in regex.split(APART, regex.sub(ALONE, r" \1 ", plain)) if w and w not in STOPS]


class Phrase(NamedTuple):
    """Neighbouring tokens that stand for the query's words first to last."""

    first: int
    last: int
    tokens: tuple[str, ...]
    exact: bool


def phrases(query: str, synonyms: dict[str, list[str]] = SYNONYMS) -> list[Phrase]:
    """What a query asks for: its words without stop words, and the synonyms of words and of pairs of neighbours."""
    words = tokens(query)
    near = {" ".join(tokens(k)): [tuple(tokens(v)) for v in vs] for k, vs in synonyms.items()}
    out = [Phrase(n, n, (w,), True) for n, w in enumerate(words)]
    for width in (1, 2):
        for n in range(len(words) - width + 1):
            out += [Phrase(n, n + width - 1, t, False) for t in near.get(" ".join(words[n : n + width]), []) if t]
    return list(dict.fromkeys(out))


def allowed_typos(word: str) -> int:
    return 2 if len(word) >= 8 else 1 if len(word) >= 4 else 0


def search(entries: DataFrame, query: str, typos: bool = False, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """(id, n_terms, typos, spread, best_attribute, n_exact) of documents with any of the query's words, or of their synonyms.

    A phrase's tokens must be neighbours within an attribute.  typos: sum over words of the fewest.  spread: the distance of the first
    places of the words in the attribute that has most of them (the weightiest of equals).  n_exact: words that stand there as asked.

    Typos are looked up in the distinct vocabulary, each token against the query's few words, and not in the entries.
    """
    asked = phrases(query, synonyms)
    if not asked:
        return entries.select("id", *(F.lit(0).cast(t).alias(n) for n, t in (("n_terms", "long"), ("typos", "long"), ("spread", "int"), ("best_attribute", "int"), ("n_exact", "long")))).limit(0)
    spark = entries.sparkSession
    rows = [(n, p.first, p.last, j, len(p.tokens), t, int(p.exact)) for n, p in enumerate(asked) for j, t in enumerate(p.tokens)]
    wanted = spark.createDataFrame(rows, "phrase int, first int, last int, offset int, size int, word string, exact int")
    if typos:
        words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(allowed_typos(w)).alias("most")) for w in sorted({r[5] for r in rows})))
        near = F.filter(words, lambda w: F.levenshtein(F.col("token"), w.word) <= F.when(F.col("token") == w.word, 0).otherwise(w.most))
        found = entries.select("token").distinct().select("token", F.explode(near).alias("w")).select("token", F.col("w.word").alias("word"), F.levenshtein("token", F.col("w.word")).alias("typos"))
        wanted = wanted.join(found, "word")
    else:
        wanted = wanted.withColumns({"token": F.col("word"), "typos": F.lit(0)})
    # a phrase has few words and a word few near tokens, so what is asked is small
    places = entries.join(wanted, "token").groupBy("id", "attribute", "phrase", "first", "last", "size", "exact", (F.col("position") - F.col("offset")).alias("start"), "offset").agg(F.min("typos").alias("typos"))
    hits = places.groupBy("id", "attribute", "phrase", "first", "last", "size", "exact", "start").agg(F.count("*").alias("n"), F.sum("typos").alias("typos")).filter("n = size")
    terms = hits.withColumn("term", F.explode(F.sequence("first", "last")))
    by_term = terms.groupBy("id", "term").agg(F.min("typos").alias("typos"), F.min("attribute").alias("attribute"), F.max(F.when(F.col("typos") == 0, F.col("exact")).otherwise(0)).alias("exact"))
    whole = by_term.groupBy("id").agg(
        F.count("*").alias("n_terms"), F.sum("typos").cast("long").alias("typos"), F.min("attribute").cast("int").alias("best_attribute"), F.sum("exact").cast("long").alias("n_exact")
    )
    firsts = terms.groupBy("id", "attribute", "term").agg(F.min("start").alias("start"))
    wide = firsts.groupBy("id", "attribute").agg(F.count("*").alias("n"), (F.max("start") - F.min("start")).cast("int").alias("spread"))
    spread = wide.groupBy("id").agg(F.max_by("spread", F.struct("n", -F.col("attribute"))).alias("spread"))
    return whole.join(spread, "id").select("id", "n_terms", "typos", "spread", "best_attribute", "n_exact")


ORDER = (F.desc, "n_terms"), (F.asc, "typos"), (F.asc, "spread"), (F.asc, "best_attribute"), (F.desc, "n_exact")


def ranked(found: DataFrame, limit: int, offset: int = 0, then: tuple[str, ...] = ("id",)) -> DataFrame:
    """A page of hits: more words, fewer typos, closer, in a weightier attribute, more as asked; then by the columns `then`."""
    return found.orderBy(*(way(c) for way, c in ORDER), *then).offset(offset).limit(limit)


def page(found: DataFrame, limit: int, offset: int = 0, then: tuple[str, ...] = ("id",)) -> tuple[DataFrame, int | None]:
    """A page of hits with their place from 1, and the offset of the next page: none if the hits end here.

    A page has MOST_HITS rows at best and is read at once.  All hits are written once, so that neither their number nor what is fetched for
    the page runs the search again.
    """
    found = cut(found)
    rows = [r.asDict() | {"place": offset + n} for n, r in enumerate(ranked(found, min(limit, MOST_HITS), offset, then).collect(), 1)]
    hits = found.sparkSession.createDataFrame(rows, T.StructType([*found.schema.fields, T.StructField("place", T.IntegerType())]))
    return hits, offset + limit if offset + limit < found.count() else None


def document(events: DataFrame) -> DataFrame:
    """What the index holds of events that anyone may find: no place beyond the town for coarse ones, and no pin for any but public, exact ones.

    events: those of cards() with the place's region as region_name, and handle, host_name, region (the host's), platform, category, tags, name,
    state, public_uri.
    """
    c = F.col
    some = F.coalesce("venue", "street", "locality", "region_name").isNotNull()
    coarse = some & is_coarse()
    filled = lambda *names: F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ", ")
    town = filled("locality", "region_name")
    place = F.when(~some, F.when(c("mode") == "virtual", "Online").otherwise("")).when(coarse, F.when(town != "", town).otherwise(HIDDEN_PLACE)).otherwise(filled("venue", "street", "locality"))
    pin = ~coarse & (c("visibility") == "public") & c("lat").between(-90, 90) & c("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon")
    epoch = lambda at: F.unix_timestamp(c(at).cast("timestamp"))
    return indexable(events).select(
        "id", "name", F.coalesce(excerpt(c("description"), DESCRIPTION_MOST), F.lit("")).alias("description"), place.alias("place"), F.coalesce("locality", F.lit("")).alias("locality"),
        "handle", F.coalesce(F.nullif("host_name", F.lit("")), "handle").alias("host_name"), F.coalesce("platform", F.lit("")).alias("platform"), F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "region", epoch("starts_at").alias("starts_unix"), epoch("ends_at").alias("ends_unix"), "visibility", "state",
        F.when(pin, c("lat")).alias("lat"), F.when(pin, c("lon")).alias("lon"), F.element_at(F.split("public_uri", "/"), -1).alias("rkey"),
    )


# What is searched, in order of weight.
ATTRIBUTES = ["name", "tag_words", "category", "place", "locality", "host_name", "handle", "description"]


def document_index(docs: DataFrame) -> DataFrame:
    """The inverted index of document(), attributes in order of weight."""
    return index(docs.withColumn("tag_words", F.array_join("tags", " . ")), ATTRIBUTES)


def narrowed(docs: DataFrame, now: Column, begin: Column | None = None, end: Column | None = None, region: str | None = None, category: str | None = None, near_to: tuple[float, float] | None = None, km: float = 25) -> DataFrame:
    """Documents within a search's filters: guards again, time (from three hours ago unless told), region, category or tag, radius.

    Only documents with a pin can be within a radius.
    """
    from_ = begin if begin is not None else now - F.expr("interval 3 hours")
    epoch = lambda at: F.unix_timestamp(at.cast("timestamp"))
    out = docs.filter(F.col("visibility").isin(*PUBLIC_LEVELS) & F.col("state").isin(*PUBLIC_STATES) & (F.col("starts_unix") >= epoch(from_)))
    if end is not None:
        out = out.filter(F.col("starts_unix") <= epoch(end))
    if region is not None:
        out = out.filter(F.col("region") == region)
    if category is not None:
        out = out.filter((F.col("category") == category) | F.array_contains("tags", category))
    if near_to is not None:
        out = out.filter(near(F.col("lat"), F.col("lon"), *near_to, km))
    return out


def fetched(hits: DataFrame, events: DataFrame) -> DataFrame:
    """The ledger's rows of a page of hits (id, place), guarded again."""
    return public(events).join(hits.select("id", "place"), "id")


def collapsed(rows: DataFrame, by_time: bool = False) -> DataFrame:
    """One row for each group of duplicates of fetched(), in order of the primary's place, or of time for searches by radius alone.

    rows: id, place, url, day, title, starts_at, rank, published_at.
    """
    each = collapse(rows, groups(rows)).select(F.col("primary_id").alias("id"), "n", "also_on")
    return rows.join(each, "id").orderBy("starts_at" if by_time else "place", "id")


def containing(events: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows whose columns hold the words as they are, for when there is no index."""
    return events.filter(F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))), F.lit(words.lower())))


def indexable(events: DataFrame) -> DataFrame:
    """Rows with a safe id that anyone may find."""
    return events.filter(F.col("id").cast("string").rlike("^[A-Za-z0-9_-]+$") & F.col("visibility").isin("public", "gated") & F.col("state").isin("live", "cancelled"))


def synced(old_index: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the index's documents, counts): the index holds what may be found now; counts are how many it holds and how many left it."""
    fresh = document(events)
    gone = swept(old_index, fresh)
    return fresh, fresh.agg(F.count("*").alias("indexed")).crossJoin(gone.agg(F.count("*").alias("removed")))  # one row each


def swept(old_index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids in the old index that the new one lacks."""
    return old_index.select("id").join(fresh.select("id"), "id", "left_anti")
