"""Removal of long repeated byte strings with a family of sorted suffix levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, Prefix, cut_points, slices
from .common import discard, id_out, staged, text_rows

GROUP_BYTES, PART_BYTES, TASK_GROUPS = 2 << 20, 1 << 23, 8
FEW, MIXED = 2, 3  # counts stop at two; MIXED: the suffixes that start alike go on differently


class Runs:
    """Sampled suffixes of one piece of text.

    In each window of `length` bytes the place whose `head` bytes have the least hash (the first of
    equals) is the window's anchor, so equal windows have their anchors at the same place in them.  A
    run is a maximal series of windows with one anchor: first and last window start, the
    suffix's head hash, and the hash of all bytes that the run covers.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int):
        head = length // 2
        self.first = self.last = np.zeros(0, np.int64)
        self.head = self.body = np.zeros(0, U)
        n, w = len(buf), length - head + 1
        long = offs[1:] - offs[:-1] >= length
        if not long.any():
            return
        h = Prefix(buf, seed=2).every(head)
        key = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)
        rows = np.full(-(-len(key) // w) * w, ~U(0), U)
        rows[: len(key)] = key
        rows = rows.reshape(-1, w)
        least = np.minimum(
            np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: n - length + 1],
            np.minimum.accumulate(rows, axis=1).ravel()[w - 1 : w + n - length],
        )
        inside = np.zeros(n + 1, np.int8)
        inside[offs[:-1][long]] += 1
        inside[offs[1:][long] - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inside[: n - length + 1]))
        anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
        self.first, self.last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
        self.head, self.body = h[anchor[new]], Prefix(buf, seed=3).span(self.first, self.last + length)


def windows(buf: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of these runs, and 96 bits of hash for each."""
    n = last - first + 1
    at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return at, Prefix(buf, seed=2).span(at, at + length), (Prefix(buf, seed=3).span(at, at + length) >> U(32)).astype(np.uint32)


def merged(head: np.ndarray, body: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix entries in order of their head, one for each head: its body and how often, or MIXED."""
    order = np.lexsort((body, head))
    head, body, seen = head[order], body[order], seen[order].astype(np.int64)
    if not len(head):
        return head, body, seen.astype(np.uint8)
    at = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    end = np.r_[at[1:], len(head)] - 1
    count = np.minimum(np.add.reduceat(seen, at), FEW)
    count[(body[at] != body[end]) | (np.maximum.reduceat(seen, at) == MIXED)] = MIXED
    return head[at], body[at], count.astype(np.uint8)


_ENTRY = [("heads", pa.binary()), ("bodies", pa.binary()), ("seen", pa.binary())]


def _rows(lead: dict, parts: int, head, body, seen, names: list[str]) -> dict:
    p, at = cut_points(head, parts)
    out = {k: [v] * len(p) for k, v in lead.items()} | {"p": p.tolist()}
    for name, x in zip(names, (head, body, seen), strict=True):
        out[name] = [x[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]
    return out


def _read(table: pa.Table, names: list[str], kinds: list) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *(np.frombuffer(x.as_py(), k) for x in table[n])]) for n, k in zip(names, kinds, strict=True)]


class SuffixLevels:
    """A logarithmic family of sorted suffix arrays, each a table with one sorted piece per key range.

    add() puts in the sorted suffixes of a new batch; while the two newest levels have
    as many batches in them, they are merged into one.  So n batches make at most log2(n) + 1
    levels, and an entry is rewritten at most log2(n) times.
    """

    def __init__(self, parts: int):
        self.parts, self.levels = parts, []

    def add(self, run: DataFrame) -> None:
        self.levels.append((1, run))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            both = staged(a.unionByName(b).groupBy("p").applyInArrow(self._merge, "p int, heads binary, bodies binary, seen binary"), "level")
            discard(a)
            discard(b)
            self.levels.append((n + m, both))

    @staticmethod
    def _merge(table: pa.Table) -> pa.Table:
        x = merged(*_read(table, ["heads", "bodies", "seen"], [U, U, np.uint8]))
        return pa.table({"p": table["p"][:1], **{n: pa.array([a.tobytes()], pa.binary()) for (n, _), a in zip(_ENTRY, x, strict=True)}})

    def table(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out


def _scan(asked: pa.Table, levels: pa.Table) -> pa.Table:
    """Merge-scan of sorted suffix heads against each level: 0 alone, FEW repeated as a whole, MIXED."""
    if not len(asked):
        return pa.table({"g": pa.array([], pa.int32()), "p": pa.array([], pa.int32()), "found": pa.array([], pa.binary())})
    sorted_levels = [[np.frombuffer(levels[n][r].as_py(), k) for n, k in (("heads", U), ("bodies", U), ("seen", np.uint8))] for r in range(len(levels))]
    out = []
    for blob in asked["heads"]:
        q = np.frombuffer(blob.as_py(), U)
        total, same, mixed = np.zeros(len(q), np.int64), np.zeros(len(q), U), np.zeros(len(q), bool)
        for head, body, seen in sorted_levels:
            at = np.minimum(np.searchsorted(head, q), len(head) - 1)
            hit = head[at] == q
            mixed |= hit & ((seen[at] == MIXED) | ((total > 0) & (same != body[at])))
            same = np.where(hit, body[at], same)
            total += np.where(hit, seen[at], 0)
        out.append(np.where(mixed, MIXED, np.where(total > 1, FEW, 0)).astype(np.uint8).tobytes())
    return pa.table({"g": asked["g"], "p": asked["p"], "found": pa.array(out, pa.binary())})


def _pieces(table: pa.Table, length: int):
    return [(lo, hi, buf, offs, Runs(buf, offs, length)) for lo, hi, buf, offs in slices(table["text"])]


def _statuses(pieces, heads: np.ndarray, found: np.ndarray):
    for *_, r in pieces:
        yield found[np.searchsorted(heads, r.head)] if len(r.head) else np.zeros(0, np.uint8)


def _joined(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in rows.sort_by("p")[name])])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, batches: int = 3) -> DataFrame:
    """(i, k, n_bytes, kept, spans) for each row: its UTF-8 bytes without the repeated ones, and these.

    A byte is repeated if a string of `length` bytes over it also starts at any other place of any
    text, the same one included; strings do not cross texts.

    1. Suffixes are sampled (Runs): any two equal strings of `length` bytes share an anchor.  Each batch
       gets a sorted suffix array, added to SuffixLevels.
    2. Documents, dealt into groups, scan their suffixes against all levels.  A suffix that
       stands alone has no repeat; one whose whole run is repeated is repeated in all windows; the
       windows of MIXED ones, at the edges of matches, are told apart by the third step.
    3. These windows are counted over the corpus by 96 bits of hash.

    All messages are sorted arrays by key range, so no group, however many copies it has, meets in
    one task.  Null and empty texts keep nothing and have no spans; rows that repeat an id and text count
    as places of their own.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    spark = docs.sparkSession
    nbytes = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = max(1, -(-nbytes // GROUP_BYTES))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // PART_BYTES))
    entry = "heads binary, bodies binary, seen binary"

    def index(it):
        held = {b: [np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.uint8)] for b in range(batches)}
        for batch in it:
            which, fresh = batch.column("b").to_numpy(), {b: [[], []] for b in range(batches)}
            for lo, hi, buf, offs in slices(batch.column("text")):
                r = Runs(buf, offs, length)
                of = which[lo:hi][np.searchsorted(offs, r.first, "right") - 1] if len(r.first) else np.zeros(0)
                for b in range(batches):
                    fresh[b][0].append(r.head[of == b]), fresh[b][1].append(r.body[of == b])
            for b in range(batches):
                h, s = (np.concatenate([x, *y]) for x, y in zip(held[b][:2], fresh[b], strict=True))
                held[b] = list(merged(h, s, np.r_[held[b][2], np.ones(len(h) - len(held[b][2]), np.uint8)]))
        for b in range(batches):
            yield pa.RecordBatch.from_pydict(_rows({"b": b}, parts, *held[b], ["heads", "bodies", "seen"]), schema=pa.schema([("b", pa.int32()), ("p", pa.int32()), *_ENTRY]))

    def sort_run(table: pa.Table) -> pa.Table:
        return SuffixLevels._merge(table).add_column(0, "b", table["b"][:1])

    drawn = rows.select(F.pmod(F.shiftright("k", 32), F.lit(batches)).cast("int").alias("b"), "text").mapInArrow(index, f"b int, p int, {entry}")
    runs = staged(drawn.groupBy("b", "p").applyInArrow(sort_run, f"b int, p int, {entry}"), "runs")
    family = SuffixLevels(parts)
    for b in range(batches):
        family.add(runs.filter(F.col("b") == b).drop("b"))

    def ask(table: pa.Table) -> pa.Table:
        heads = np.unique(np.concatenate([np.zeros(0, U), *(r.head for *_, r in _pieces(table, length))]))
        p, at = cut_points(heads, parts)
        return pa.table({"p": pa.array(p, pa.int32()), "g": pa.array([table["g"][0].as_py()] * len(p), pa.int32()), "heads": pa.array([heads[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)], pa.binary())})

    def edges(table: pa.Table, found: pa.Table) -> pa.Table:
        """The windows to tell apart, to their key ranges; what the scan found goes on to the group itself."""
        pieces, g = _pieces(table, length), table["g"][0].as_py()
        heads = np.unique(np.concatenate([np.zeros(0, U), *(r.head for *_, r in pieces)]))
        status = _joined(found, "found")
        hi64, lo32 = [np.zeros(0, U)], [np.zeros(0, np.uint32)]
        for (_, _, buf, _, r), s in zip(pieces, _statuses(pieces, heads, status), strict=True):
            if (s == MIXED).any():
                _, a, b = windows(buf, r.first[s == MIXED], r.last[s == MIXED], length)
                hi64.append(a), lo32.append(b)
        a, b = np.concatenate(hi64), np.concatenate(lo32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.r_[new, len(a)]), FEW).astype(np.uint8)
        out = _rows({"g": g}, parts, a[new], b[new], count, ["heads", "bodies", "seen"])
        for name, x in (("g", g), ("p", -1 - g), ("heads", status.tobytes()), ("bodies", b""), ("seen", b"")):
            out[name].append(x)
        return pa.table(out, schema=pa.schema([("g", pa.int32()), ("p", pa.int32()), *_ENTRY]))

    def tell(table: pa.Table) -> pa.Table:
        if table["p"][0].as_py() < 0:
            return pa.table({"g": table["g"], "p": table["p"], "found": table["heads"]})
        sizes = [len(x.as_py()) for x in table["seen"]]
        a, b, c = _read(table, ["heads", "bodies", "seen"], [U, np.uint32, np.uint8])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        total = np.add.reduceat(c[order].astype(np.int64), np.flatnonzero(new))
        out = np.empty(len(a), np.uint8)
        out[order] = (total > 1)[np.cumsum(new) - 1]
        return pa.table({"g": table["g"], "p": table["p"], "found": pa.array([x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], pa.binary())})

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        pieces = _pieces(table, length)
        heads = np.unique(np.concatenate([np.zeros(0, U), *(r.head for *_, r in pieces)]))
        own = np.less(found["p"].to_numpy(), 0)
        status, repeated = _joined(found.filter(own), "found"), _joined(found.filter(~own), "found")
        at, hi64, lo32, statuses = [], [np.zeros(0, U)], [np.zeros(0, np.uint32)], list(_statuses(pieces, heads, status))
        for (_, _, buf, _, r), s in zip(pieces, statuses, strict=True):
            x, a, b = windows(buf, r.first[s == MIXED], r.last[s == MIXED], length) if (s == MIXED).any() else (np.zeros(0, np.int64), hi64[0], lo32[0])
            at.append(x), hi64.append(a), lo32.append(b)
        a, b = np.concatenate(hi64), np.concatenate(lo32)
        order = np.lexsort((b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
        flags = np.zeros(len(a), bool)
        flags[order] = repeated[np.cumsum(new) - 1] > 0
        kept, spans, size, used = [], [], [], 0
        for (lo, hi, buf, offs, r), s, x in zip(pieces, statuses, at, strict=True):
            step = np.zeros(len(buf) + 1, np.int32)
            np.add.at(step, r.first[s == FEW], 1)
            np.add.at(step, r.last[s == FEW] + length, -1)
            x = x[flags[used : (used := used + len(x))]]
            np.add.at(step, x, 1)
            np.add.at(step, x + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            any_gone = np.r_[0, np.cumsum(gone)]
            for d in range(hi - lo):
                a_, z_ = offs[d], offs[d + 1]
                size.append(int(z_ - a_))
                if any_gone[z_] == any_gone[a_]:
                    kept.append(buf[a_:z_].tobytes()), spans.append([])
                    continue
                m = gone[a_:z_]
                kept.append(buf[a_:z_][~m].tobytes())
                turns = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
                spans.append([{"start": int(p), "end": int(q)} for p, q in turns.reshape(-1, 2)])
        return pa.table(
            {"i": table["i"], "k": table["k"], "n_bytes": pa.array(size, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        )

    dealt = rows.select(F.pmod("k", F.lit(groups)).cast("int").alias("g"), "i", "k", "text").repartition(-(-groups // TASK_GROUPS), "g")
    asked = dealt.groupBy("g").applyInArrow(ask, "p int, g int, heads binary")
    found = asked.groupBy("p").cogroup(family.table().groupBy("p")).applyInArrow(_scan, "g int, p int, found binary")
    sent = dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(edges, f"g int, p int, {entry}")
    told = sent.groupBy("p").applyInArrow(tell, "g int, p int, found binary")
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(
        cut, "i long, k long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).select(
        id_out().alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
