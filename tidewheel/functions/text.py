"""Column functions on titles, descriptions and contacts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and texts that results depend on.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?1[\s.-]?)?\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"
EMAIL_GONE, PHONE_GONE = "[email removed]", "[phone removed]"
TITLE_STOPS = "the|a|an|of|and|at|in|on|for|to|with"
FOOTERS = [
    r"(?i)\n*Get up-to-date information at:?\s*https?://\S+\s*$",
    r"(?i)\n*(?:Event|Hosted) (?:by|on) Luma\b.*$",
    r"(?i)\n*RSVP (?:at|on) (?:lu\.ma|luma\.com)\S*\s*$",
    r"(?i)\n*Learn more (?:at|on) Meetup\S*\s*$",
]
# Category rules in order, on lower-case text.
CATEGORY_RULES = [
    ("volunteering", r"\b(volunteer(?:s|ing)?|work ?day|clean-?up|mutual aid|service day)\b"),
    ("markets", r"\b(farmers'? ?market|market|swap|flea|bazaar|craft fair|maker'?s? ?fair)\b"),
    ("sustainability", r"\b(sustainab\w*|climate|zero waste|compost\w*|permaculture|regenerat\w*|solar|recycl\w*|garden(?:ing)?|seed)\b"),
    ("civic", r"\b(city council|town hall|civic|election|ballot|policy|public hearing|neighborhood meeting|advocacy|democracy|organiz(?:e|ing) meeting)\b"),
    ("film", r"\b(film|movie|screening|cinema|documentary)\b"),
    ("literary", r"\b(book|poetry|poem|author|reading|writers?|storytelling|zine)\b"),
    ("music", r"\b(concert|live music|band|dj|jazz|bluegrass|folk|choir|singer|songwriter|orchestra|symphony|open mic|jam|drum)\b"),
    ("arts", r"\b(art|gallery|exhibit\w*|theater|theatre|dance|paint\w*|sculpt\w*|craft|improv|comedy|opening reception|studio)\b"),
    ("food", r"\b(potluck|dinner|brunch|lunch|cook\w*|tasting|food|bake|beer|wine|coffee|tea|cider|chef)\b"),
    ("tech", r"\b(tech|software|coding|hackathon|developers?|startup|ai\b|open source|web3|crypto|data|python|javascript|maker ?space)\b"),
    ("business", r"\b(networking|entrepreneur\w*|business|founders?|pitch|workshop for professionals|career|job fair)\b"),
    ("education", r"\b(class|course|lecture|workshop|seminar|talk|lesson|training|tutorial|learn\w*|study group|panel)\b"),
    ("wellness", r"\b(yoga|meditat\w*|mindful\w*|breathwork|sound bath|wellness|health|healing|therapy|fitness|pilates|tai chi|qigong)\b"),
    ("spirituality", r"\b(dharma|sangha|church|temple|prayer|ceremony|ritual|spiritual|buddhist|sabbath|shabbat|mass|worship|kirtan)\b"),
    ("outdoors", r"\b(hike|hiking|trail|camping|bike ride|cycling|climb\w*|paddle|river|mountain|nature walk|bird\w*|outdoor)\b"),
    ("sports", r"\b(race|5k|10k|marathon|tournament|league|soccer|basketball|pickleball|volleyball|run club|skate)\b"),
    ("family", r"\b(kids?|children|family|toddler|story ?time|teen|youth|all ages)\b"),
    ("nightlife", r"\b(party|dance party|late night|karaoke|trivia night|bar crawl|club night)\b"),
    ("community", r"\b(community|meetup|gathering|social|neighbors?|potluck|celebration|festival|block party|circle|assembly)\b"),
]
# Source tags that name a category.
TAG_CATEGORIES = {
    "music": "music", "concert": "music", "arts": "arts", "art": "arts", "theater": "arts", "theatre": "arts", "dance": "arts", "food": "food", "dining": "food",
    "community": "community", "education": "education", "class": "education", "workshop": "education", "outdoors": "outdoors", "hiking": "outdoors",
    "family": "family", "kids": "family", "civic": "civic", "government": "civic", "politics": "civic", "tech": "tech", "technology": "tech",
    "wellness": "wellness", "health": "wellness", "yoga": "wellness", "spirituality": "spirituality", "religion": "spirituality", "markets": "markets",
    "market": "markets", "volunteering": "volunteering", "volunteer": "volunteering", "sports": "sports", "fitness": "sports", "film": "film", "movies": "film",
    "literary": "literary", "books": "literary", "business": "business", "networking": "business", "sustainability": "sustainability",
    "environment": "sustainability", "nightlife": "nightlife", "party": "nightlife",
}


def _decomposed() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one plain letter or digit and marks, and these; marks alone have none."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    plain = {}
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if x not in marks)
        if len(base) == 1 and base != c and base.isascii() and base.isalnum():
            plain[c] = base.lower()
    return "".join(plain) + "".join(marks), "".join(plain.values())


#: For translate() on lower-case text: letters to plain ones, marks to nothing.
ACCENTED, PLAIN = _decomposed()


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, EMAIL_GONE), PHONE, PHONE_GONE)


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def phones(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)))


def norm_title(text: Column) -> Column:
    """Lower case, accents off, `&` spelt out, stop words and punctuation out."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "&", " and ")
    words = F.split(F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*TITLE_STOPS.split("|"))), " ")


def excerpt(text: Column, most: int = 280) -> Column:
    flat = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[#*_>`]", "")
    flat = F.btrim(F.regexp_replace(flat, r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, most - 1), r"\s+\S*$", ""), F.lit("..."))
    return F.when(flat == "", None).when(F.length(flat) <= most, flat).otherwise(cut)


def clean_description(text: Column) -> Column:
    """Tags out with links, lists and headings kept as marks; feed footers and spare blank space out."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern, put in (
        (r"(?is)<(script|style)\b.*?</\1>", ""), (r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"), (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<h([1-6])\b[^>]*>", "\n\n# "), (r"(?i)</?(b|strong)\b[^>]*>", "**"), (r"(?i)</?(i|em)\b[^>]*>", "_"),
        (r"(?i)</(p|div|h[1-6]|ul|ol|table|tr)>", "\n\n"), (r"<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    ):
        out = F.regexp_replace(out, pattern, put)
    for pattern in FOOTERS:
        out = F.regexp_replace(out, pattern, "")
    out = F.btrim(F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"), F.lit(" \n\t"))
    return F.when(out != "", out)


def categorize(title: Column, body: Column, tags: Column | None = None) -> Column:
    """The first tag that names a category; else the first rule that the title meets, else a tag, else the beginning of the body."""
    rules = lambda c: F.coalesce(*(F.when(F.lower(c).rlike(pattern), name) for name, pattern in CATEGORY_RULES))
    if tags is None:
        return F.coalesce(rules(title), rules(F.substring(body, 1, 600)))
    named = F.create_map(*(F.lit(x) for pair in TAG_CATEGORIES.items() for x in pair))
    first = lambda of: F.get(F.array_compact(F.transform(tags, of)), F.lit(0))
    return F.coalesce(first(lambda t: F.try_element_at(named, F.lower(F.btrim(t)))), rules(title), first(rules), rules(F.substring(body, 1, 600)))


def fallback_identity(title: Column, start: Column, place: Column) -> Column:
    """An identity for listings whose source gives none: hash of title, start and place."""
    return F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("\0", norm_title(title), start, F.btrim(F.lower(F.coalesce(place, F.lit(""))))), 256), 1, 24))


def source_fingerprint(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", kind, F.lower(F.btrim(key)))
