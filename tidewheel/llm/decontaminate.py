"""Benchmark decontamination by winnowed k-gram fingerprints, extended to exact windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_out, small, staged, text_rows, with_key
from .native import covered, gram_hashes, let, word_hashes

WINDOW, GRAM = 13, 5
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_EDGES = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def item_words(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII, A-Z in lower case; a null has none."""
    return _parted(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))


def folded_words(text: Column) -> Column:
    """Like item_words(), at the same places, but with all letters in lower case, which takes less time.

    Words that item_words() makes equal are equal here; so fingerprints of these find all that theirs would.
    """
    return _parted(_folded(F.coalesce(text, F.lit(""))))


def _folded(text: Column) -> Column:
    """Lower case with one small sigma: which of the two lower() gives for a capital depends on the letters around it."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _parted(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_EDGES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _APART))


def winnowed(grams: Column, width: int) -> Column:
    """Places (from 0) of the least hash of each `width` neighbouring grams, the first of equals."""
    least = lambda i: let(F.slice(grams, i, width), lambda s: i - 2 + F.array_position(s, F.array_min(s)).cast("int"))
    count = F.size(grams) - width + 1
    return F.when(count < 1, F.array().cast("array<int>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), least))
    )


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(i, k, n_words, n_hit, items): for each row the words inside benchmark windows and the items hit.

    A window is `window` consecutive words of an item (item_id, text); of a shorter item, all its
    words.  Of any `window` words the k-gram with the least hash is among the fingerprints on both sides, so joining
    fingerprints finds at least one place in every shared window; the windows around such places
    are then compared as text.  The grams of items shorter than a window are looked up at every place.

    Fingerprints and windows of the benchmark are broadcast up to BROADCAST_ROWS rows and joined by a
    shuffle beyond.  A null or empty text has no words; items without words or without an id are never reported
    (windows of the latter still count as hits).  Repeated items and rows change nothing else.
    """
    bench = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = lambda w, s, m: F.array_join(F.slice(w, s + 1, m), " ")
    m = F.least(F.size("w"), F.lit(window))
    pieces = bench.select("item", m.alias("m"), F.explode(F.sequence(F.lit(0), F.size("w") - m)).alias("s"), "w")
    pieces = staged(pieces.select("item", "m", cut(F.col("w"), F.col("s"), F.col("m")).alias("piece"), F.slice("w", F.col("s") + 1, F.col("m")).alias("w")).distinct(), "windows")
    distinct = staged(pieces.select("m", "piece", "w").distinct(), "pieces")

    rows = text_rows(docs, id_col, text_col)
    hashed = rows.select("i", "k", word_hashes(folded_words(F.col("text"))).alias("h"))
    sizes = sorted(r.m for r in distinct.select("m").distinct().collect())  # at most `window` lengths

    def prints(h: Column, size: int) -> Column:
        at = lambda p, x: F.struct(F.lit(size).alias("m"), p.alias("at"), x.alias("print"))
        if size < window:
            return F.transform(gram_hashes(h, size), lambda x, p: at(p, x))
        return let(gram_hashes(h, gram), lambda g: F.transform(winnowed(g, window - gram + 1), lambda p: at(p, F.get(g, p))))

    # one pass over the documents for all lengths
    own, found = distinct.select("m", word_hashes(F.transform("w", _folded)).alias("h")), rows.select("i", "k", F.lit(window).alias("m"), F.lit(0).alias("at")).limit(0)
    if sizes:
        own = own.select(F.explode(F.coalesce(*(F.when(F.col("m") == size, prints(F.col("h"), size)) for size in sizes))).alias("f")).select("f.m", "f.print").distinct()
        theirs = hashed.select("i", "k", F.explode(F.concat(*(prints(F.col("h"), size) for size in sizes))).alias("f")).select("i", "k", "f.*")
        found = theirs.join(small(staged(own, "prints")), ["m", "print"], "left_semi").select("i", "k", "m", "at")
    places = found.groupBy("i", "k").agg(F.collect_set(F.struct("m", "at")).alias("places"))

    def around(words: Column, places: Column) -> Column:
        back = lambda p: F.when(p.m == window, F.lit(window - gram)).otherwise(F.lit(0))
        starts = F.flatten(
            F.transform(places, lambda p: F.transform(F.sequence(p["at"] - back(p), p["at"]), lambda s: F.struct(p.m.alias("m"), s.alias("s"))))
        )
        ok = F.filter(F.array_distinct(starts), lambda x: (x.s >= 0) & (x.s + x.m <= F.size(words)))
        return F.transform(ok, lambda x: F.struct(x.m.alias("m"), x.s.alias("s"), F.array_join(F.slice(words, x.s + 1, x.m), " ").alias("piece")))

    near = rows.join(places, ["i", "k"]).dropDuplicates(["i", "k"]).select(
        "i", "k", F.explode(let(item_words(F.col("text")), lambda w: around(w, F.col("places")))).alias("x")
    )
    exact = near.select("i", "k", "x.*").join(small(distinct.select("m", "piece")), ["m", "piece"])
    exact = staged(exact.select("i", "k", "m", "s", "piece"), "exact")
    # a shorter window [s, s + m) covers less than `window` words, so coverage goes by words, not by starts
    spread = exact.groupBy("i", "k", "m").agg(F.array_sort(F.collect_set("s")).alias("starts"))
    each = spread.groupBy("i", "k").agg(F.collect_list(F.struct("m", "starts")).alias("by"))
    whole = F.when(
        (F.size("by") == 1) & (F.get("by", F.lit(0)).m == window), covered(F.get("by", F.lit(0)).starts, window)
    ).otherwise(
        F.size(
            F.array_distinct(
                F.flatten(F.transform("by", lambda b: F.flatten(F.transform(b.starts, lambda s: F.sequence(s, s + b.m - 1)))))
            )
        ).cast("long")
    )
    hits = each.select("i", "k", whole.alias("n_hit"))
    named = (
        exact.select("i", "k", "m", "piece").distinct().join(pieces.select("m", "piece", "item"), ["m", "piece"])
        .groupBy("i", "k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    counts = rows.select("i", "k", F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    out = counts.join(hits.join(named, ["i", "k"], "left"), ["i", "k"], "left")
    return out.select("i", "k", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows.  Columns as in docs."""
    bad = overlaps(docs, items).filter(is_contaminated()).select("i", "k").distinct()
    return with_key(docs, bad, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        id_out().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
