"""Periodic runs of words: maximal stretches that repeat with a small period, and texts without the repetitions."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices
from .common import id_out, text_rows
from .native import space_words

LEAST_WORDS, LEAST_TIMES = 6, 4
# A difference cover: every residue modulo COVER is the difference of two of these.
COVER, SAMPLE = 13, (0, 1, 3, 9)
#: Places of the harmonic grid that are looked at in one go.
GRID = 1 << 20

_IN = np.full(COVER, -1)
_IN[list(SAMPLE)] = np.arange(len(SAMPLE))
#: _SHIFT[a, b]: the least d that brings residues a and b both into the sample.
_SHIFT = np.array([[next(d for d in range(COVER) if _IN[(a + d) % COVER] >= 0 and _IN[(b + d) % COVER] >= 0) for b in range(COVER)] for a in range(COVER)])


class Extension:
    """Longest common extension of two places of a sequence whose last value occurs once.

    Only suffixes at places of the difference cover are sorted: by their first COVER values, then by doubling.  Their
    neighbours' common lengths go into a sparse table.  A query compares the few values up to the next pair of sampled
    places, and asks the table for the rest.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.n, self.seq = n, np.r_[seq, np.full(2 * COVER, -1)]
        place = (COVER * np.arange(n // COVER + 1)[:, None] + np.array(SAMPLE)).ravel()
        # place s of the sample is len(SAMPLE) * (p // COVER) + _IN[p % COVER], so COVER places on is len(SAMPLE) on
        self.place = place = place[place < n]
        m = len(place)
        columns = [self.seq[place + t] for t in range(COVER)]
        order = np.lexsort(columns[::-1])
        changed = np.zeros(m, bool)
        for c in columns:
            changed[1:] |= c[order][1:] != c[order][:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(changed)
        levels, hop = [rank], len(SAMPLE)
        while rank.max(initial=0) < m - 1 and hop < m:
            key = (rank + 1) * (m + 1)
            key[:-hop] += rank[hop:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
            levels.append(rank)
            hop *= 2
        self.rank = rank
        table = [self._neighbours(order, levels)]
        while 2 << len(table) - 1 <= m:
            last, half = table[-1], 1 << len(table) - 1
            table.append(np.minimum(last[: m - 2 * half + 1], last[half : m - half + 1]))
        self.table = table

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common length of each sampled suffix, in order, with the one before: blocks from the largest down, then single values."""
        m = len(order)
        a, b, blocks = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, m - 1), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < m
            same = inside & (levels[level][np.minimum(a, m - 1)] == levels[level][np.minimum(b, m - 1)])
            a += same * (len(SAMPLE) << level)
            b += same * (len(SAMPLE) << level)
            blocks += same.astype(np.int64) << level
        i, j = self.place[order[:-1]] + COVER * blocks, self.place[order[1:]] + COVER * blocks
        return np.r_[0, COVER * blocks + self._compared(i, j, np.full(len(i), COVER))].astype(np.int64)

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the `most` values from i and from j agree before the first that don't."""
        out, on = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(COVER):
            on = on[(most[on] > t)]
            on = on[self.seq[np.minimum(i[on] + t, self.n)] == self.seq[np.minimum(j[on] + t, self.n + 1)]]
            if not len(on):
                break
            out[on] = t + 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of i and j, which differ."""
        shift = _SHIFT[i % COVER, j % COVER]
        out = self._compared(i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        at = lambda p: self.rank[len(SAMPLE) * (p // COVER) + _IN[p % COVER]]
        x, y = at(a), at(b)
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[far[own]] += np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << int(k))])
        return out


def runs_of(seq: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """(start, length, period) of the maximal runs in seq, by start and period.

    seq begins and ends with values that occur once, as do all that no run may cross; no stretch between these is over `longest`.  A run of
    period q is at least `times` periods long, so that seq[i] == seq[i + q] on times - 1 periods or more: places that far apart meet each run.  Those that
    hold equal values are extended both ways.  A stretch that also has a smaller period is found with that one and counts once.
    """
    n, step = len(seq), max(1, times - 1)
    on = longest // times
    starts, lengths, periods = [], [], []
    there = back = None
    q = 1
    while q <= on:
        # as many periods as fit into GRID places
        last = q
        places = -(-(n - q) // (step * q))
        while last < on and places + (n // (step * (last + 1)) + 1) <= GRID:
            last += 1
            places += -(-(n - last) // (step * last))
        period = np.arange(q, last + 1)
        count = -(-(n - period) // (step * period))
        own = np.repeat(period, count)
        i = step * own * (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
        q = last + 1
        same = seq[i] == seq[i + own]
        i, own = i[same], own[same]
        if not len(i):
            continue
        if there is None:
            there, back = Extension(seq), Extension(seq[::-1])
        ahead, behind = there(i, i + own), back(n - i, n - i - own)
        length = ahead + behind + own
        good = length >= np.maximum(least, times * own)
        starts.append((i - behind)[good])
        lengths.append(length[good])
        periods.append(own[good])
    if not starts:
        return np.zeros((0, 3), np.int64)
    found = np.stack([np.concatenate(x) for x in (starts, lengths, periods)], axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, k, n_words, runs array<struct<start, length, period>>, collapsed) of each document.

    Words are runs of bytes other than ASCII white space, numbered from 0.  A run is at least LEAST_WORDS words and LEAST_TIMES periods
    long.  collapsed: the words that no run has after its first period, joined by one space.  A null or
    empty text has no words and an empty collapsed text; rows that repeat an id are looked at each.

    Texts are laid end to end between values that occur once, as many as make a slice, so that short ones share the work of a slice; a longer text
    is a slice of its own, at some 150 bytes of memory a word.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column("text")):
                data = buf.tobytes()
                texts = [data[a:z].split() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                sizes = np.array([len(x) for x in texts], np.int64)
                number: dict[bytes, int] = {}
                seq, begins, at = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64), np.zeros(len(texts), np.int64), 1
                for j, words in enumerate(texts):
                    begins[j] = at
                    seq[at : at + len(words)] = [number.setdefault(w, len(number)) for w in words]
                    at += len(words) + 1
                seq[np.r_[begins - 1, len(seq) - 1]] = len(number) + np.arange(len(texts) + 1)
                found = runs_of(seq, int(sizes.max(initial=0)))
                doc = np.searchsorted(begins, found[:, 0], "right") - 1
                # after a run's first period its words are dropped
                edges = np.zeros(len(seq) + 1, np.int64)
                np.add.at(edges, found[:, 0] + found[:, 2], 1)
                np.add.at(edges, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(edges)[:-1] == 0
                collapsed = [b" ".join(compress(words, kept[a : a + len(words)].tolist())) for a, words in zip(begins.tolist(), texts, strict=True)]
                parts = pa.StructArray.from_arrays([pa.array(found[:, 0] - begins[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(_RUNS.value_type))
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i")[lo:hi], batch.column("k")[lo:hi], pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array(collapsed, pa.binary())],
                    ["i", "k", "n_words", "runs", "collapsed"],
                )

    fields = "i long, k long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    out = text_rows(docs, id_col, text_col).mapInArrow(run, fields)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeating(docs: DataFrame) -> DataFrame:
    """documents with a planted repetition where crc32 of the id ends in 0: from word a on, word i becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    with_words = docs.select("doc_id", "text", F.when(h % 10 == 0, space_words(F.col("text"))).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("long"))
    placed = with_words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.withColumns({"best": best, "lines": lines})
    return out.select(
        id_out().alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
