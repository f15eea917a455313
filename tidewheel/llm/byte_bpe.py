"""Byte-level BPE: ids of texts by the ranks of a vocabulary, and the bytes of ids."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE, slices
from .common import id_out, text_rows

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
#: Elements of one padded matrix at most, but for a single row that is longer; pieces and bytes of pieces that a task remembers.
MATRIX, MOST_PIECES, MOST_BYTES = 1 << 21, 1 << 20, 1 << 25

# Ranges that are letters or numbers from Unicode 17 on, which the encoder's library (Unicode 16) doesn't know yet.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def splitter(pattern: str):
    """text -> its pieces, by a pattern with the classes of letters and numbers that the encoder's library has."""
    usual, newer = regex.compile(pattern), regex.compile(f"[{NEWER}]")
    # most texts have none of the former and nothing beyond the basic plane, which is faster to see
    maybe = re.compile(f"[{NEWER[: NEWER.index(chr(92) + 'U')]}\U00010000-\U0010ffff]")
    other = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{NEWER}]]")
    for name in ("L", "N"):
        other = other.replace(f" ?\\p{{{name}}}", f" ?[\\p{{{name}}}--[{NEWER}]]")
    rare = regex.compile(other, regex.V1)
    return lambda text: (rare if not text.isascii() and maybe.search(text) and newer.search(text) else usual).findall(text)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of flat, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class PairTable:
    """Hash table from a pair of ids to the id of their merge: open addressing with linear steps, at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE, np.int32)
        keys = self._keys(left, right)
        rest, at = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[rest[free]]
            put = self.keys[at] == keys[rest]
            self.values[at[put]] = merged[rest[put]]
            rest, at = rest[~put], at[~put] + 1 & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, which is its rank; NONE for pairs that don't."""
        keys = self._keys(left, right)
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        rest = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(rest):
            at = at[rest] + 1 & self.mask if len(at) != len(rest) else at + 1 & self.mask
            found, own = self.keys[at], keys[rest]
            hit = found == own
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (found != EMPTY)
            rest, at = rest[on], at[on]
        return out


class Vocabulary:
    """Ranks of byte strings, a line each: base64 and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank_of = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.rank_of]
        if missing:
            raise ValueError(f"no rank for byte {missing[0]}")
        self.single = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.size = max(self.rank_of.values()) + 1
        blobs = [b""] * self.size
        for blob, rank in self.rank_of.items():
            blobs[rank] = blob
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.lengths = np.array([len(x) for x in blobs], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        get, pairs = self.rank_of.get, []
        for blob, rank in self.rank_of.items():
            for cut in range(1, len(blob)):
                a = get(blob[:cut])
                if a is not None and (b := get(blob[cut:])) is not None:
                    pairs.append((a, b, rank))
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)

    def merged(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each blob), all blobs by rounds of merges in matrices of blobs of like length."""
        lengths = np.array([len(x) for x in blobs], np.int64)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        rows, counts, ids = [], [], []
        for width in np.unique(bucket):
            own = np.flatnonzero(bucket == width)
            step = max(1, MATRIX >> int(width))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                for at, n, flat in self._rounds(np.frombuffer(b"".join(blobs[j] for j in part), np.uint8), lengths[part]):
                    rows.append(part[at])
                    counts.append(n)
                    ids.append(flat)
        if not rows:
            return np.zeros(0, np.int32), lengths
        row, n, flat = np.concatenate(rows), np.concatenate(counts), np.concatenate(ids)
        order = np.argsort(row, kind="stable")
        return gathered(flat, (np.cumsum(n) - n)[order], n[order]), n[order]

    def _rounds(self, flat: np.ndarray, size: np.ndarray):
        """(rows, numbers of ids, ids) of the rows that are done, round after round.

        Each round merges every row's leftmost pair of least rank, and then closes the gaps.  Further pairs of that rank
        are merged in the same round, from left to right, as far as the merges before bring up no pair of lower rank: up to there
        the order of single merges would take the same ones.  So a million equal characters take some twenty rounds.
        """
        row, width = np.arange(len(size)), int(size.max())
        full = np.arange(width) < size[:, None]
        ids, rank = np.full(full.shape, -1, np.int32), np.full(full.shape, NONE)
        ids[full] = self.single[flat]
        both = full[:, 1:]
        rank[:, :-1][both] = self.pairs.ranks(ids[:, :-1][both], ids[:, 1:][both])
        while True:
            least = rank.min(axis=1)
            done = least == NONE
            if done.any():
                yield row[done], size[done], ids[done][full[done]]
                if done.all():
                    return
                on = ~done
                width = int(size[on].max())
                row, size, least = row[on], size[on], least[on]
                ids, rank, full = ids[on, :width], rank[on, :width], full[on, :width]
            r, c = np.nonzero(rank == least[:, None])
            # of equal pairs that overlap, every second one
            start = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)]
            at = np.arange(len(r))
            even = (at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0
            r, c = r[even], c[even]
            new = least[r]
            chained = np.r_[False, (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 2)]
            before = np.where(chained, new, ids[r, np.maximum(c - 1, 0)])
            has_after = c + 2 < size[r]
            after = ids[r, np.where(has_after, c + 2, 0)]
            lower = (np.where(c > 0, self.pairs.ranks(before, new), NONE) < new) | (np.where(has_after, self.pairs.ranks(new, after), NONE) < new)
            first = np.r_[True, r[1:] != r[:-1]]
            earlier = np.cumsum(lower) - lower
            nth_row = np.cumsum(first) - 1
            keep = earlier == earlier[first][nth_row]
            r, c, new = r[keep], c[keep], new[keep]
            ids[r, c] = new
            stay = full
            stay[r, c + 1] = False
            size = size - np.bincount(r, minlength=len(size))
            left_ids, left_rank = ids[stay], rank[stay]
            width = int(size.max())
            full = np.arange(width) < size[:, None]
            ids, rank = np.full(full.shape, -1, np.int32), np.full(full.shape, NONE)
            ids[full], rank[full] = left_ids, left_rank
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            c = c - (np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])))
            end = c + 1 >= size[r]
            rank[r, c] = np.where(end, NONE, self.pairs.ranks(ids[r, c], ids[r, np.where(end, 0, c + 1)]))
            inner = c > 0
            r, c = r[inner], c[inner]
            rank[r, c - 1] = self.pairs.ranks(ids[r, c - 1], ids[r, c])

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's bytes end)."""
        n = self.lengths[ids]
        return gathered(self.bytes, self.starts[ids], n), np.cumsum(n)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts; each distinct piece is encoded once, and remembered up to MOST_PIECES pieces or MOST_BYTES bytes of pieces."""

    def __init__(self, path: str, pattern: str):
        self.words, self.split = vocabulary(path), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held, self.ids, self.counts = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        blobs = [x.encode() for x in pieces]
        known = [self.words.rank_of.get(x, -1) for x in blobs]
        ids, counts = self.words.merged([x for x, rank in zip(blobs, known, strict=True) if rank < 0])
        known = np.array(known, np.int32)
        n = np.ones(len(known), np.int64)
        n[known < 0] = counts
        flat = np.repeat(known, n)
        flat[flat < 0] = ids
        for x in pieces:
            self.place[x] = len(self.place)
        self.held += sum(map(len, blobs))
        self.ids, self.counts = np.concatenate([self.ids, flat]), np.concatenate([self.counts, n])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last one's end)."""
        if len(self.place) > MOST_PIECES or self.held > MOST_BYTES:
            self.forget()
        parts = [self.split(x) for x in texts]
        new = [x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in self.place]
        if new:
            self.learn(new)
        ends = np.cumsum([0, *map(len, parts)])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(ends[-1]))
        counts = self.counts[at]
        flat = gathered(self.ids, (np.cumsum(self.counts) - self.counts)[at], counts)
        return flat, np.r_[0, np.cumsum(counts)][ends]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, k, ids array<int>) of each document by the ranks at path, each match of pattern for itself, without special tokens.

    A null or empty text has no ids; bytes that aren't UTF-8 count as the replacement character.  Rows that repeat an id are encoded each.  A
    task holds SLICE bytes of texts at a time, or one longer text.  Pieces of many kilobytes (letters without a break) cost a round over
    the piece for each distinct merge in it.
    """

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column("text")):
                data = buf.tobytes()
                ids, ends = encoder.encode([data[a:z].decode("utf-8", "replace") for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("i")[lo:hi], batch.column("k")[lo:hi], lists], ["i", "k", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "i long, k long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(i, k, ids, bytes): the bytes that the ids stand for; null where ids is null or holds an id (or null) that the vocabulary lacks."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            lo = 0
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")) - 1)
                values = lists.values[int(ends[lo]) : int(ends[hi])]
                ids = values.fill_null(-1).to_numpy(zero_copy_only=False)
                wrong = (ids < 0) | (ids >= words.size)
                bad = np.diff(np.r_[0, np.cumsum(wrong)][ends[lo : hi + 1] - ends[lo]]) > 0
                data, at = words.decoded(np.where(wrong, 0, ids))
                cuts = np.r_[0, at][ends[lo : hi + 1] - ends[lo]]
                blob = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                gone = pa.array(bad | lists[lo:hi].is_null().to_numpy(zero_copy_only=False))
                blob = pc.if_else(gone, pa.scalar(None, pa.binary()), blob)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("i", "k", "ids")), blob], ["i", "k", "ids", "bytes"])
                lo = hi

    return tokens.select("i", "k", "ids").mapInArrow(run, "i long, k long, ids array<int>, bytes binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded(encoded(docs, path, public_tokenizers.PATTERN), path).select(
        id_out().alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
