"""Venues, coordinates, images: fill what a listing leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.places import in_box
from ..functions.text import ACCENTED, PLAIN


# Words that don't tell venues apart.
NOISE = r"^(the|co|colorado|usa|us|\d{5})$"


def venue_text(text: Column) -> Column:
    """Plain lower-case words, `&` spelt out, without quotes, the state, the country and a postal code."""
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), "['‘’ʼ]", "")
    words = F.split(F.regexp_replace(F.regexp_replace(bare, "&", " and "), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.rlike(NOISE)), " ")


def address_key(text: Column) -> Column:
    """The key that coordinates of a place are kept under."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), "[.,]+", ",")
    return F.btrim(F.regexp_replace(out, r",\s*,", ","))


def venue_match(texts: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, venue, key): the longest venue key that stands in the text as whole words; of equals that of the least venue.

    venues: venue, name and, if there is one, an array `aliases`.  Texts (id, text) are cut into runs of as many words as some key has and
    joined by equality, instead of every text with every key.  Of venues that share a key only the least is joined, so a common name costs a
    row for each text.  The numbers of words that keys have come to the driver: at most as many as the longest name has words; the keys don't,
    as their size isn't known before they are made.
    """
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))) if "aliases" in venues.columns else F.array("name")
    keys = venues.select("venue", F.explode(F.array_distinct(F.transform(names, venue_text))).alias("key")).filter(F.length("key") >= 3).groupBy("key").agg(F.min("venue").alias("venue"))
    sizes = [r.n for r in keys.select(F.size(F.split("key", " ")).alias("n")).distinct().orderBy("n").collect()]
    words = texts.select("id", F.split(venue_text(F.col("text")), " ").alias("w"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = [run(n) for n in sizes]
    grams = words.select("id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("key"))
    best = F.max_by(F.struct("venue", "key"), F.struct(F.length("key"), -F.col("venue"), "key"))
    return grams.join(keys.hint("merge"), "key").groupBy("id").agg(best.alias("b")).select("id", "b.*")


def relabelled(events: DataFrame, zone: str) -> DataFrame:
    """Timed events with a place in the region get its zone; their instant stays.  Events: mode, all_day, tz, lat, lon, tz_inferred."""
    here = (F.col("mode") != "virtual") & ~F.coalesce("all_day", F.lit(False)) & F.coalesce(F.col("tz") != zone, F.lit(True)) & in_box(F.col("lat"), F.col("lon"))
    here = F.coalesce(here, F.lit(False))
    return events.withColumns({"tz": F.when(here, zone).otherwise(F.col("tz")), "tz_inferred": F.when(here, True).otherwise(F.col("tz_inferred"))})


def without_stray_pins(events: DataFrame) -> DataFrame:
    """Pins outside the region go; the words of the place stay."""
    keep = in_box(F.col("lat"), F.col("lon"))
    return events.withColumns({c: F.when(keep, F.col(c)) for c in ("lat", "lon")})


def placed(events: DataFrame, venues: DataFrame, cache: DataFrame, town: str, region: str) -> DataFrame:
    """Events with what the gazetteer and the cache of coordinates know of their place.

    events: id, mode, name, street, locality, region, lat, lon, precision, hint (the venue of a source that has one).  venues: venue, name,
    aliases, street, locality, region, lat, lon, precision.  cache: key (address_key), lat, lon, precision (exact or city).

    A venue found in the place's words gives its name and fills what is blank.  If none is, and the event states a bare room (no street,
    town or pin), the venue that the hint names gives all, with the room after its name.  Without a pin the cache gives one; that of a
    town marks the place as such.  Words that name the default town stand for it.
    """
    stray = without_stray_pins(events)
    some = F.coalesce("name", "street", "locality").isNotNull() & (F.col("mode") != "virtual")
    rows = stray.withColumn("_words", F.when(some, F.concat_ws(", ", *(F.nullif(c, F.lit("")) for c in ("name", "street", "locality")))))
    known = venues.select("venue", F.struct("name", "street", "locality", "region", "lat", "lon", "precision").alias("v"))
    found = lambda text, name: venue_match(rows.select("id", text.alias("text")).filter("text <> ''"), venues).join(known, "venue").select("id", F.col("v").alias(name))
    out = rows.join(found(F.col("_words"), "_v"), "id", "left").join(found(F.when(some, F.col("hint")), "_h"), "id", "left")
    out = out.withColumn("_key", address_key(F.col("_words"))).join(cache.select(F.col("key").alias("_key"), F.struct("lat", "lon", "precision").alias("_c")), "_key", "left")
    c = F.col
    bare = c("_v").isNull() & c("_h").isNotNull() & c("street").isNull() & c("locality").isNull() & c("lat").isNull()
    room = F.when(c("name").isNotNull() & (c("name") != c("_h.name")), F.concat(c("_h.name"), F.lit(", "), c("name"))).otherwise(c("_h.name"))
    fill = lambda n: F.when(bare, c(f"_h.{n}")).otherwise(F.coalesce(n, F.when(c("_v").isNotNull(), c(f"_v.{n}"))))
    out = out.select(
        *(x for x in events.columns if x not in ("name", "street", "locality", "region", "lat", "lon", "precision")), "_words", "_c", bare.alias("_bare"),
        F.when(bare, room).otherwise(F.coalesce("_v.name", "name")).alias("name"), *(fill(n).alias(n) for n in ("street", "locality", "region", "lat", "lon")),
        F.when(c("_v").isNotNull(), F.when(c("_v.precision") == "exact", c("precision")).otherwise("neighborhood")).otherwise(c("precision")).alias("precision"),
    )
    pinned = c("lat").isNull() & c("_c.lat").isNotNull() & ~c("_bare")
    out = out.withColumns({"lat": F.when(pinned, c("_c.lat")).otherwise(c("lat")), "lon": F.when(pinned, c("_c.lon")).otherwise(c("lon")), "precision": F.when(pinned & (c("_c.precision") != "exact"), "city").otherwise(c("precision"))})
    default = c("locality").isNull() & F.coalesce(F.contains(F.lower("_words"), F.lit(town.lower())), F.lit(False))
    out = out.withColumns({"region": F.when(default, region).otherwise(c("region")), "locality": F.when(default, town).otherwise(c("locality"))})
    return out.select(*events.columns)


def cached(rows: DataFrame, cache: DataFrame, key: str, now: Column, days: int = 7) -> DataFrame:
    """rows with the cached value of their key, null if there is none or it is too old."""
    fresh = cache.filter(F.col("fetched_at") >= now - F.expr(f"interval {days} days"))
    return rows.join(fresh.select(key, "value"), key, "left")


def image_reuse(pages: DataFrame, least: int = 3) -> DataFrame:
    """(domain, image, n, is_default): an image on `least` pages of a domain is the site's default."""
    return pages.groupBy("domain", "image").agg(F.countDistinct("url").alias("n")).withColumn("is_default", F.col("n") >= least)


def pick_image(rows: DataFrame) -> DataFrame:
    """The listing's own image, then the page's data, the platform's cover, and the page's preview unless it is the site's default."""
    ok = lambda c: F.when(~F.lower(F.col(c)).rlike("placeholder|default|logo|blank|spacer"), F.col(c))
    return rows.withColumn("image", F.coalesce(ok("native_image"), ok("data_image"), ok("cover_image"), F.when(~F.coalesce("is_default", F.lit(False)), ok("preview_image"))))


# Words that end a street's name, directions before and after it, and texts that are no place.
SUFFIXES = (
    "st street ave avenue av rd road blvd boulevard dr drive ln lane ct court cir circle way pl place pkwy parkway ter terrace trl trail hwy highway loop sq square walk row path run bend crossing xing plz plaza spur route rte"
    " expy expressway aly alley mall commons ranch ridge point pt view park"
).split()
DIRECTIONS = "n s e w ne nw se sw north south east west northeast northwest southeast southwest".split()
NOWHERE = [
    "online", "virtual", "remote", "zoom", "zoom call", "zoom meeting", "google meet", "teams", "webinar", "livestream", "live stream", "streaming", "tba", "tbd", "n/a", "na", "none", "unknown",
    "to be announced", "to be determined", "to be confirmed", "location tba", "location tbd", "location to be announced", "location to be determined", "various", "various locations", "multiple locations",
    "see description", "see the description", "see website", "see the website", "see link", "see the link", "see event page", "see the event page", "check description", "check the description", "check website", "check the website",
    "hybrid", "in person", "virtual event", "online event", "online only", "no location",
]
_DIRECTION = rf"(?:{'|'.join(DIRECTIONS)})"
_STREET = rf"\d+[a-z]?\s+(?:{_DIRECTION}\.?\s+)?[a-z0-9'’.\- ]*?\b(?:{'|'.join(SUFFIXES)})\b\.?(?:\s+{_DIRECTION}\b\.?)?"
_LOOSE = r"(?i)^\d+[a-z]?\s+\S+(?:\s+\S+){0,4}$"
_UNIT = r"(?i)\b(?:suite|ste|unit|apt|apartment|room|rm|bldg|building|floor|fl)\b\.?\s*[a-z0-9-]+|#\s*[a-z0-9-]+"
_ZIP, _STATE = r"\b(\d{5})(?:-\d{4})?\b", r"(?:^|[,\s])([A-Z]{2}|(?i:colo|colorado))\.?$"
_WORDS = r"[^\d,;•·|]"
#: A postal code after a state, else one that a separator or another number stands before and that begins no street; and one that ends a line of words.
_CODE = (
    rf"^(.*(?:^|[,\s])(?:[A-Z]{{2}}|(?i:colo|colorado))\.?\s+|(?:{_WORDS}*[\d,;•·|].*|{_WORDS}*\s[-–—]+\s{_WORDS}*)\b(?!(?i:{_STREET})))"
    rf"{_ZIP}(.*)$"
)
_LAST_CODE = rf"^([^\n\d,;•·|]+ ){_ZIP}$"
#: Words of the longest name of a town that is looked for at the end of a segment.
TOWN_WORDS = 3


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[\s,;:.•·|–—-]+|[\s,;:.•·|–—-]+$", "")


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _lifted(text: Column, after_town: Column | bool) -> Column:
    """struct(segments, region, zip) of a line: the code, and the state at the end of what is left.

    A number of five digits may be that of a house or belong to a name ("Hall 12345"), so one that ends a line of words alone is a code only
    where after_town holds, since a town stands before it.
    """
    # a tidy line has no line break, so one marks what is lifted out
    line = F.regexp_replace(_tidy(text), _CODE, "$1 $3\n$2")
    last = F.regexp_replace(line, _LAST_CODE, "$1\n$2")
    line = line if after_town is False else last if after_town is True else F.when(after_town, last).otherwise(line)

    def parts(coded: Column, stated: Column) -> Column:
        state = F.get(stated, F.lit(1))
        segments = F.filter(F.transform(F.split(_tidy(stated[0]), r"\s*[,;•·|]\s*|\s+[-–—]\s+"), _tidy), lambda s: s != "")
        return F.struct(segments.alias("segments"), F.when(state.rlike("(?i)^colo"), "CO").otherwise(state).alias("region"), F.get(coded, F.lit(1)).alias("zip"))

    return _let(F.split(line, "\n"), lambda coded: _let(F.split(F.regexp_replace(_tidy(coded[0]), _STATE, "\n$1"), "\n"), lambda stated: parts(coded, stated)))


def with_towns(rows: DataFrame, key: str, text: str, towns: DataFrame) -> DataFrame:
    """rows with `town`, struct(whole, at, words, name): the known town that a line names, or null.

    towns: (name).  A segment that is a town counts before one that ends with it; of each kind the last segment, and of its endings
    the longest.  Lines are exploded to their segments and the endings of these of up to TOWN_WORDS words, which are looked up by an equi-join.
    """
    segments = _lifted(F.col(text), True)["segments"]
    words = lambda s: F.split(s, " ")
    ending = lambda s, at, n: F.struct(
        (n == F.size(words(s))).alias("whole"), at.alias("at"), n.alias("words"), F.lower(F.array_join(F.slice(words(s), F.size(words(s)) - n + 1, n), " ")).alias("low"))
    of = lambda s, at: F.transform(F.array_distinct(F.array_append(F.sequence(F.lit(1), F.least(F.size(words(s)), F.lit(TOWN_WORDS))), F.size(words(s)))), lambda n: ending(s, at, n))
    found = rows.select(F.col(key).alias("key_"), F.explode(F.flatten(F.transform(segments, of))).alias("e")).select("key_", "e.*")
    known = towns.select("name").filter("name is not null").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    best = found.join(known, "low").groupBy("key_").agg(F.max(F.struct("whole", "at", "words", "name")).alias("town"))
    return rows.join(best, F.col(key) == F.col("key_"), "left").drop("key_")


def address(text: Column, town: Column | None = None) -> Column:
    """struct(street, locality, region, postal_code, venue) of a one-line address; null for a text that is no place.

    town: what with_towns() found; without it the last of several segments counts as the locality.  A street begins a segment with its
    number, or else stands anywhere in one; the segments before it are the venue.
    """
    none = lambda c: F.when(c != "", c)

    def anchored(s: Column) -> Column:
        bare = F.btrim(F.regexp_replace(s, _UNIT, ""))
        whole = F.regexp_extract(bare, f"(?i)^({_STREET})", 1)
        return F.when(whole != "", _tidy(whole)).when(bare.rlike(_LOOSE), bare)

    anywhere = lambda s: none(_tidy(F.regexp_extract(F.regexp_replace(s, _UNIT, ""), rf"(?i)\b({_STREET})", 1)))

    def parsed(line: Column) -> Column:
        segments = line["segments"]
        if town is None:
            named = F.when((F.size(segments) > 1) & anchored(F.element_at(segments, -1)).isNull(), F.element_at(segments, -1))
            left = F.when(named.isNotNull(), F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(segments)
        else:
            cut = lambda s: F.array_join(F.slice(F.split(s, " "), 1, F.greatest(F.size(F.split(s, " ")) - town["words"], F.lit(0))), " ")
            named, left = town["name"], F.filter(F.transform(segments, lambda s, i: F.when(i == town["at"], cut(s)).otherwise(s)), lambda s: s != "")

        def rest(left: Column) -> Column:
            at = lambda of: F.get(F.filter(F.transform(left, lambda s, i: F.struct(i.alias("i"), of(s).alias("street"))), lambda x: x.street.isNotNull()), F.lit(0))
            return _let(F.coalesce(at(anchored), at(anywhere)), lambda hit: found(left, hit))

        def found(left: Column, hit: Column) -> Column:
            before = F.filter(left, lambda s, i: (hit.i.isNull() | (i < hit.i)) & anchored(s).isNull())
            return F.struct(hit.street.alias("street"), named.alias("locality"), line["region"].alias("region"), line["zip"].alias("postal_code"), none(F.array_join(before, ", ")).alias("venue"))

        return _let(left, rest)

    place = _let(_tidy(text), lambda line: line.rlike("[A-Za-z]") & ~F.lower(line).isin(*NOWHERE))
    return F.when(place, _let(_lifted(text, False if town is None else town.isNotNull()), parsed))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row for each key."""
    return rows.withColumn("nth_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")
