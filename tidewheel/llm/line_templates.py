"""Line deduplication with a fixed-depth tree of line templates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, small, staged, text_rows, with_key
from .native import SPACE

DEPTH, LEAST_DOCS, ALIKE = 4, 10, 0.7
SHORT, STEP, NEAR = 10, 5, 0.9
FIELD = "<*>"


def _masked(words: Column) -> Column:
    """Words, one space apart, with those that have a digit as FIELD."""
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(words)


def parsed(docs: DataFrame, id_col: str, text_col: str, depth: int, least_docs: int) -> DataFrame:
    """(i, k, at, line, n, need, leaf) for each line with a word; at counts lines from 0, n is the number of words.

    line has one space between words.  leaf: hash of n and of the first `depth` words, those with a digit as FIELD: the path to a
    leaf of the tree.  Only these words are masked here, so that a pass over all lines stays cheap.
    """
    lines = text_rows(docs, id_col, text_col).select("i", "k", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).filter("line <> ''")
    odd = F.contains("line", F.lit("  "))
    for c in SPACE.strip(" \n"):
        odd = odd | F.contains("line", F.lit(c))
    lines = lines.withColumn("line", F.when(odd, F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")).otherwise(F.col("line")))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    lines = lines.withColumn("n", n.cast("int"))
    return lines.withColumns({"need": docs_needed(F.col("n"), least_docs), "leaf": F.xxhash64("n", _masked(F.substring_index("line", " ", depth)))})


def docs_needed(n: Column, least_docs: int = LEAST_DOCS) -> Column:
    """Documents that a near-equal line of n words needs: one less for each STEP words above SHORT, 2 at least."""
    return F.least(F.lit(least_docs), F.greatest(F.lit(2), least_docs - F.floor((n - SHORT) / STEP))).cast("int")


class Mined(NamedTuple):
    """lines (i, k, at, leaf, t) of busy leaves; texts (leaf, t, masked, n, need, docs); ranked (leaf, t, j, s); found (leaf, t, seed, level)."""

    lines: DataFrame
    texts: DataFrame
    ranked: DataFrame
    found: DataFrame


def mined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS, alike: float = ALIKE) -> Mined:
    """The lines of recurring templates.

    1. A leaf of the tree holds the lines of one length and beginning.  Leaves that too few documents reach are left out.
    2. Equal lines of a leaf, words with a digit masked, are one text; it has `docs` documents.
    3. Fields: the support of a word at a place is the sum of docs over the leaf's texts that have it there.  A text's words in order
       of support, the leading ones first, give a chain of templates: one for each level, which keeps the words of that support or more
       and has fields elsewhere.  Words that a template fixes have at least its documents, so
       texts that differ in fields only meet at the level of its rarest fixed word.
    4. A template recurs if the texts that have it in their chain stand in enough distinct documents: `least_docs` where it keeps
       the share `alike` of the words, docs_needed() where it keeps NEAR.  A text goes to the recurring template with
       most documents (the longest of equals, then the greatest of hashes).

    Leaves where every text has enough documents of its own need no third step.  t and seed are hashes of 64 and 128 bits within a leaf.
    """
    lines = parsed(docs, id_col, text_col, depth, least_docs)
    busy = lines.select("leaf", "need", "i", "k").distinct().groupBy("leaf", "need").agg(F.count("*").alias("docs")).filter("docs >= need").select("leaf")
    busy = staged(busy, "busy")
    met = lines.join(small(busy), "leaf").select("i", "k", "at", "leaf", "n", "need", _masked(F.col("line")).alias("masked"))
    rest = staged(met.withColumn("t", F.xxhash64("masked")), "lines")
    texts = staged(
        rest.select("leaf", "t", "masked", "n", "need", "i", "k").distinct().groupBy("leaf", "t", "masked", "n", "need").agg(F.count("*").alias("docs")), "texts"
    )
    unsettled = staged(texts.filter("docs < need").select("leaf").distinct(), "open")
    undecided = small(unsettled)

    body = texts.join(undecided, "leaf", "left_semi").select("leaf", "t", "n", "need", "docs", F.posexplode(F.split("masked", " ")).alias("j", "w"))
    words = body.filter(F.col("j") >= depth).withColumn("w", F.xxhash64("w", "j"))
    support = words.groupBy("leaf", "need", "w").agg(F.sum("docs").alias("s")).filter("s >= need").select("leaf", "w", "s")
    ranked = staged(words.join(support, ["leaf", "w"]), "ranked")

    least = lambda share: F.ceil(F.col("n") * share - 1e-6)
    chain = W.partitionBy("leaf", "t").orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, W.currentRow)
    steps = ranked.select(
        "leaf", "t", "n", "need", "docs", "s", (F.count("*").over(chain) + depth).alias("m"), F.bit_xor("w").over(chain).alias("x"), F.bit_xor(F.xxhash64("w")).over(chain).alias("y")
    ).filter(F.col("m") >= least(alike))
    steps = steps.dropDuplicates(["leaf", "t", "s"]).withColumn("enough", F.when(F.col("m") >= least(max(alike, NEAR)), F.col("need")).otherwise(F.lit(least_docs)))
    short = texts.join(undecided, "leaf", "left_semi").filter(F.col("n") <= depth)  # nothing beyond the leading words
    steps = steps.unionByName(short.select("leaf", "t", "n", "need", "docs", *(F.lit(0).cast("long").alias(c) for c in ("s", "x", "y")), F.col("n").cast("long").alias("m"), F.col("need").alias("enough")))
    steps = staged(steps.withColumn("seed", F.struct("x", "y")).drop("x", "y"), "steps")

    totals = staged(steps.groupBy("leaf", "seed", "m", "enough").agg(F.max("docs").alias("one"), F.sum("docs").alias("all")).filter(F.col("all") >= F.col("enough")), "totals")
    unsure = steps.join(totals.filter(F.col("one") < F.col("enough")), ["leaf", "seed", "m", "enough"], "left_semi")
    places = unsure.join(rest.select("leaf", "t", "i", "k").distinct(), ["leaf", "t"]).select("leaf", "seed", "m", "enough", "i", "k").distinct()
    counted = places.groupBy("leaf", "seed", "m", "enough").agg(F.count("*").alias("docs")).filter(F.col("docs") >= F.col("enough")).drop("docs")
    sure = totals.filter(F.col("one") >= F.col("enough")).select("leaf", "seed", "m", "enough")
    good = totals.join(sure.unionByName(counted), ["leaf", "seed", "m", "enough"], "left_semi")
    best = steps.join(good, ["leaf", "seed", "m", "enough"]).groupBy("leaf", "t").agg(F.max(F.struct("all", "m", "seed", "s")).alias("b"))
    closed = texts.join(undecided, "leaf", "left_anti").select("leaf", "t", F.struct(F.col("t").alias("x"), F.col("t").alias("y")).alias("seed"), F.lit(0).cast("long").alias("level"))
    found = closed.unionByName(best.select("leaf", "t", "b.seed", F.col("b.s").alias("level")))
    found = staged(found, "found")
    for done in (busy, unsettled, steps, totals):
        discard(done)
    return Mined(rest, texts, ranked, found)


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(i, k, at, leaf, seed): the lines of recurring templates (mined()), which leaf and seed name."""
    known = mined(docs, id_col, text_col, **how)
    for done in (known.texts, known.ranked):
        discard(done)
    return known.lines.join(small(known.found.drop("level")), ["leaf", "t"]).select("i", "k", "at", "leaf", "seed")


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, **how) -> DataFrame:
    """(leaf, seed, template, n_lines) for each recurring template: its words, with FIELD for its fields, and its lines."""
    known = mined(docs, id_col, text_col, depth=depth, **how)
    lines = known.lines.join(known.found, ["leaf", "t"]).groupBy("leaf", "seed").agg(F.count("*").alias("n_lines"))
    one = known.found.groupBy("leaf", "seed").agg(F.min(F.struct("t", "level")).alias("o")).select("leaf", "seed", "o.t", "o.level")
    kept = known.ranked.join(one, ["leaf", "t"]).filter(F.col("s") >= F.col("level")).groupBy("leaf", "t").agg(F.collect_set("j").alias("js"))
    both = one.join(known.texts.select("leaf", "t", "masked"), ["leaf", "t"]).join(kept, ["leaf", "t"], "left")
    fixed = lambda j: (j < depth) | (F.col("level") == 0) | F.coalesce(F.array_contains("js", j), F.lit(False))
    made = F.array_join(F.transform(F.split("masked", " "), lambda w, j: F.when(fixed(j), w).otherwise(FIELD)), " ")
    return both.select("leaf", "seed", made.alias("template")).join(lines, ["leaf", "seed"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = True, **how) -> DataFrame:
    """(i, k, gone): places of the lines of a row to drop.

    With keep_first the document with the least id among those with a template keeps its lines, so that text that only
    copies share isn't lost altogether.
    """
    hit = recurring(docs, id_col, text_col, **how)
    if keep_first:
        first = hit.groupBy("leaf", "seed").agg(F.min(F.struct("i", "k")).alias("first"))
        hit = hit.join(small(staged(first, "first")), ["leaf", "seed"]).filter(F.struct("i", "k") != F.col("first"))
    return hit.groupBy("i", "k").agg(F.collect_set("at").alias("gone"))


def without_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with text_col without the dropped lines, and a new last column: how many were dropped.

    Lines are parted by \\n; lines without a word always stay.  A null text stays null, an empty one
    empty.  Rows that repeat an id and text count as one document and get the same text.  The new column is `lines_dropped`, with
    underscores in front if docs has that name in any case.
    """
    (name,) = fresh(docs, "lines_dropped")
    gone = dropped_lines(docs, id_col, text_col, **how).withColumnsRenamed({"gone": name})
    both = with_key(docs, gone, "left", id_col, text_col)
    text, places = F.col(f"`{text_col}`"), F.col(f"`{name}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, j: ~F.array_contains(places, j)), "\n")
    return both.withColumns({text_col: F.when(places.isNull(), text).otherwise(left), name: F.coalesce(F.size(places), F.lit(0))}).select(*(f"`{c}`" for c in docs.columns), name)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines counted before and after, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = without_templates(docs)
    return out.select(
        "doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col("lines_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, place, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM d)),
m AS (SELECT *, len(w) AS n, list_slice(w, 1, 4) AS head, least(10, greatest(2, 10 - floor((len(w) - 10) / 5))) AS need FROM l WHERE len(w) > 0),
busy AS (SELECT n, head FROM m GROUP BY n, head, need HAVING count(DISTINCT doc_id) >= need),
texts AS (SELECT w, n, head, need, count(DISTINCT doc_id) AS docs FROM m SEMI JOIN busy USING (n, head) GROUP BY ALL),
undecided AS (SELECT DISTINCT n, head FROM texts WHERE docs < need),
body AS (SELECT w, n, head, need, docs, unnest(range(5, n + 1)) AS j FROM texts SEMI JOIN undecided USING (n, head)),
words AS (SELECT *, w[j] AS x FROM body),
support AS (SELECT n, head, j, x, sum(docs) AS s FROM words GROUP BY n, head, need, j, x HAVING s >= need),
ranked AS (SELECT w, n, head, need, docs, j, x, s FROM words JOIN support USING (n, head, j, x)),
levels AS (SELECT DISTINCT w, s AS level FROM ranked),
steps AS (
  SELECT w, n, head, need, docs, count(*) + 4 AS m, list(struct_pack(j := j, x := x) ORDER BY j) AS seed FROM ranked JOIN levels USING (w) WHERE s >= level GROUP BY w, n, head, need, docs, level
  HAVING 10 * m >= 7 * n
  UNION ALL SELECT w, n, head, need, docs, n, [] FROM texts SEMI JOIN undecided USING (n, head) WHERE n <= 4),
good AS (
  SELECT n, head, seed, m FROM (SELECT s.n, s.head, s.seed, s.m, CASE WHEN s.n <= 4 OR 10 * s.m >= 9 * s.n THEN s.need ELSE 10 END AS enough, doc_id FROM steps s JOIN m ON m.w = s.w)
  GROUP BY n, head, seed, m, enough HAVING count(DISTINCT doc_id) >= enough),
ranks AS (SELECT w, steps.n, steps.head, seed, m, sum(docs) OVER (PARTITION BY steps.n, steps.head, seed) AS total FROM steps SEMI JOIN good USING (n, head, seed, m)),
found AS (
  SELECT w, n, head, arg_max(seed, (total, m)) AS seed FROM ranks GROUP BY ALL
  UNION ALL SELECT w, n, head, list_transform(w, lambda x, j: struct_pack(j := j, x := x)) FROM texts ANTI JOIN undecided USING (n, head)),
hit AS (SELECT m.doc_id, m.place, min(m.doc_id) OVER (PARTITION BY m.n, m.head, f.seed) AS first FROM m JOIN found f ON m.w = f.w),
gone AS (SELECT doc_id, list(place) AS gone FROM hit WHERE doc_id <> first GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, j: NOT list_contains(gone, j - 1)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
