"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio of trusted to raw text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged
from .native import covered, gram_hashes, let, space_words, word_hashes

BUCKETS = 1 << 14
TRUSTED = 20_000
LEAST_SCORE = -0.08
PRIOR = 200_000


def repeated_words(hashes: Column, width: int = 8) -> Column:
    """Words in windows of `width` words that occur twice or more in the text."""

    def places(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(
            ranked,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, j: F.struct(
                                x.i.alias("i"),
                                ((F.get(s, j - 1).g == x.g) | F.coalesce(F.get(s, j + 1).g == x.g, F.lit(False))).alias("twice"),
                            ),
                        ),
                        lambda x: F.coalesce(x.twice, F.lit(False)),
                    ),
                    lambda x: x.i,
                )
            ),
        )

    return let(
        gram_hashes(hashes, width),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(places(g), width)),
    )


def n_grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    return F.transform(F.concat(hashes, gram_hashes(hashes, 2)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def base_rules(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, grams) of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        space_words(whole),
        lambda w: let(
            word_hashes(w),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeated_words(h).alias("n_repeat_words"),
                n_grams(h, BUCKETS).alias("grams"),
            ),
        ),
    )


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, good): how often each bucket occurs in all of docs and in the trusted documents.

    trusted: one column `id`, at most TRUSTED rows, so it is broadcast.  Rows that repeat an id and text count once on the
    trusted side, so that a document left out of it leaves no copy of its own there.
    """
    split = lambda text: F.explode(let(word_hashes(space_words(text)), lambda h: n_grams(h, buckets))).alias("bucket")
    i, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    raw = docs.select(split(text)).groupBy("bucket").agg(F.count("*").alias("raw"))
    chosen = docs.select(i.alias("id"), text.alias("text")).join(F.broadcast(trusted), "id").withColumn("k", F.xxhash64("id", "text")).dropDuplicates(["id", "k"])
    good = chosen.select(split(F.col("text"))).groupBy("bucket").agg(F.count("*").alias("good"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return staged(full.join(raw, "bucket", "left").join(good, "bucket", "left").na.fill(0), "buckets")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids whose labels all say good and not toxic; of more than `most`, those with the least hashes."""
    return (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .filter("q = 1 and t = 0")
        .select("id")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs with a struct column `quality`: the base statistics, base_failed, score and kept.

    score is the mean weight of the text's hashed words and word pairs, so length doesn't count; a
    text is kept if it passes the base rules and its score is `least` or more.  Every document goes
    through the same rule with the same constant.

    A bucket's weight is the log of its share in trusted documents over its share in all.  The trusted side is smoothed by
    PRIOR counts dealt like the raw side's, so a weight without evidence is 0 and few labels reject little; trusted documents
    are scored without their own counts.  With no trusted labels all scores are 0.

    A null or empty text has no words: base_failed, not kept, score null.  Rows that repeat stay.
    """
    trusted = staged(trusted_ids(labels), "trusted")
    table = bucket_counts(docs, trusted, id_col, text_col).orderBy("bucket").collect()
    raws, goods = sum(r.raw for r in table), sum(r.good for r in table)
    share = [(r.raw + 1) / (raws + BUCKETS) for r in table]
    # BUCKETS numbers each, whatever the corpus size; as constants they stay inside the projection
    fixed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    model = fixed([math.log((r.good + PRIOR * s) / ((goods + PRIOR) * s)) for r, s in zip(table, share, strict=True)], "double")
    good, shares = fixed([r.good for r in table], "bigint"), fixed(share, "double")

    def without_own(x: Column) -> Column:
        """Sum of the weights of a trusted text, from sorted buckets, with each bucket's own count left out."""
        part = lambda a: F.when(a.n > 0, a.n * F.log((F.get(x.g, a.b) - a.n + PRIOR * F.get(x.s, a.b)) / F.get(x.s, a.b))).otherwise(0.0)
        state = lambda b, n, total: F.struct(b.alias("b"), n.alias("n"), total.alias("total"))
        return F.aggregate(
            F.array_sort(x.b.grams),
            state(F.lit(0), F.lit(0), F.lit(0.0)),
            lambda a, b: F.when((a.n > 0) & (a.b == b), state(b, a.n + 1, a.total)).otherwise(state(b, F.lit(1), a.total + part(a))),
            lambda a: a.total + part(a),
        ) - F.size(x.b.grams) * F.log(goods - F.size(x.b.grams) + F.lit(float(PRIOR)))

    (own,) = fresh(docs, "trusted_id")
    marked = docs.join(F.broadcast(trusted.select(F.col("id").alias(own))), F.col(f"`{id_col}`") == F.col(own), "left")
    found = let(
        F.struct(base_rules(F.col(f"`{text_col}`")).alias("b"), model.alias("w"), good.alias("g"), shares.alias("s")),
        lambda x: F.struct(
            *(x.b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            ((x.b.n_words < 20) | (100 * x.b.n_repeat_words > 30 * x.b.n_words)).alias("base_failed"),
            F.when(
                F.size(x.b.grams) > 0,
                F.when(F.col(own).isNotNull(), without_own(x)).otherwise(F.aggregate(x.b.grams, F.lit(0.0), lambda a, g: a + F.get(x.w, g))) / F.size(x.b.grams),
            ).alias("score"),
        ),
    )
    (name,) = fresh(docs, "quality")
    with_kept = let(found, lambda q: q.withField("kept", ~q.base_failed & F.coalesce(q.score >= least, F.lit(False))))
    return marked.withColumn(name, with_kept).select(*(f"`{c}`" for c in docs.columns), name)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject.  Columns as in docs."""
    out = scored(docs, labels)
    return out.filter(F.col(f"`{out.columns[-1]}`").kept).select(*(f"`{c}`" for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return out.select("doc_id", "quality").select("doc_id", *(F.col("quality")[c].alias(c) for c in fields))
