"""Language-model scores: a smoothed bigram backoff automaton over all training documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, Prefix, counts_of, cut_points, mix, slices, words
from .common import id_out, staged, text_rows

END, START = U(0x1B873593CC9E2D51), U(0x85EBCA6BC2B2AE35)
GROUP_BYTES, PART_KEYS = 8 << 20, 1 << 21
UNI, BI = 0, 1


def tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by END, and the place of each text's END."""
    out, ends, at = [], [], 0
    for lo, hi, buf, offs in slices(column):
        s, e, first = words(buf, offs)
        h = Prefix(buf, fold=True).span(s, e)
        tok = np.full(len(h) + hi - lo, END, U)
        stop = first[1:] + np.arange(hi - lo)
        body = np.ones(len(tok), bool)
        body[stop] = False
        tok[body] = h
        out.append(tok)
        ends.append(stop + at)
        at += len(tok)
    return (np.concatenate(out), np.concatenate(ends)) if out else (np.zeros(0, U), np.zeros(0, np.int64))


def bigrams(tok: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[np.r_[0, ends[:-1] + 1]] = START
    return mix(prev * U(0x9FB21C651E98DF25) + (tok ^ U(0x2545F4914F6CDD1D)))


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The least unsigned type that holds x, and x in it."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) < 2 ** (8 * int(k[1])))
    return kind, x.astype(kind).tobytes()


def _vocabulary(rows: DataFrame, parts: int) -> DataFrame:
    """One row per key range: training tokens, distinct ones; and bytes of all texts."""

    def local(batches):
        held, pending, size = (np.zeros(0, U), np.zeros(0, np.int64)), [], 0

        def merged():
            k = np.concatenate([held[0], *(x[0] for x in pending)])
            return counts_of(k, np.concatenate([held[1], *(x[1] for x in pending)]))

        nbytes = 0
        for batch in batches:
            train = batch.filter(batch.column("train"))
            nbytes += batch.column("text").nbytes
            for lo, hi, buf, offs in slices(train.column("text")):
                s, e, _ = words(buf, offs)
                k, c = counts_of(np.r_[Prefix(buf, fold=True).span(s, e), np.full(hi - lo, END, U)])
                pending.append((k, c))
                size += len(k)
                if size > PART_KEYS:
                    held, pending, size = merged(), [], 0
        k, c = merged()
        p, at = cut_points(k, parts)
        blobs = [narrow(c[a:z]) for a, z in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_pydict(
            {
                "p": pa.array(np.r_[p, [-1]], pa.int32()),
                "keys": pa.array([k[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)] + [b""], pa.binary()),
                "kind": pa.array([x[0] for x in blobs] + ["u1"], pa.string()),
                "counts": pa.array([x[1] for x in blobs] + [b""], pa.binary()),
                "nbytes": pa.array([0] * len(p) + [nbytes], pa.int64()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        n = v = 0
        if table["p"][0].as_py() >= 0:
            k = np.concatenate([np.frombuffer(x.as_py(), U) for x in table["keys"]])
            n = sum(int(np.frombuffer(x.as_py(), t.as_py()).sum(dtype=np.int64)) for x, t in zip(table["counts"], table["kind"], strict=True))
            v = len(np.unique(k))
        return pa.table({"n": [n], "v": [v], "nbytes": [sum(table["nbytes"].to_pylist())]}, schema=pa.schema([("n", pa.int64()), ("v", pa.int64()), ("nbytes", pa.int64())]))

    blobs = rows.mapInArrow(local, "p int, keys binary, kind string, counts binary, nbytes long")
    return blobs.groupBy("p").applyInArrow(total, "n long, v long, nbytes long")


def _sent(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """Distinct n-grams of one group of documents with their counts in its training documents, by key range."""
        tok, ends = tokens(table["text"])
        weight = np.repeat(table["train"].to_numpy().astype(np.int64), np.diff(np.r_[-1, ends]))
        cols: dict[str, list] = {"p": [], "g": [], "kind": [], "keys": [], "type": [], "counts": []}
        for kind, keys in ((UNI, tok), (BI, bigrams(tok, ends))):
            k, c = counts_of(keys, weight)
            p, at = cut_points(k, parts)
            for q, a, z in zip(p, at, at[1:], strict=False):
                t, blob = narrow(c[a:z])
                for name, x in zip(cols, (int(q), table["g"][0].as_py(), kind, k[a:z].tobytes(), t, blob), strict=True):
                    cols[name].append(x)
        return pa.table(cols, schema=pa.schema([("p", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("type", pa.string()), ("counts", pa.binary())]))

    return run


def _totals(table: pa.Table) -> pa.Table:
    """For one key range and order: each group's n-grams get their counts over the whole corpus."""
    keys = [np.frombuffer(x.as_py(), U) for x in table["keys"]]
    c = np.concatenate([np.frombuffer(x.as_py(), t.as_py()).astype(np.int64) for x, t in zip(table["counts"], table["type"], strict=True)])
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    new = np.r_[True, k[order][1:] != k[order][:-1]]
    sums = np.add.reduceat(c[order], np.flatnonzero(new))
    back = np.empty(len(k), np.int64)
    back[order] = sums[np.cumsum(new) - 1]
    out = [narrow(x) for x in np.split(back, np.cumsum([len(x) for x in keys])[:-1])]
    return pa.table(
        {"g": table["g"], "p": table["p"], "kind": table["kind"], "type": pa.array([x[0] for x in out], pa.string()), "counts": pa.array([x[1] for x in out], pa.binary())}
    )


def _scored(n: int, v: int, add: float, strength: float):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Walk the automaton over each text of one group.

        A state is the last token, if training has it, else the root.  The arc from state u on token
        w has the smoothed bigram weight if u w occurs in training; else the failure arc with weight
        strength / (c(u) + strength) leads to the root, whose arc on w has the smoothed unigram weight.
        The weights leaving a state sum to one.
        """
        tok, ends = tokens(table["text"])
        grams = bigrams(tok, ends)
        counts = []
        for kind, keys in ((UNI, tok), (BI, grams)):
            r = replies.filter(np.equal(replies["kind"].to_numpy(), kind)).sort_by("p")
            found = np.concatenate([np.frombuffer(x.as_py(), t.as_py()).astype(np.int64) for x, t in zip(r["counts"], r["type"], strict=True)])
            _, inverse = np.unique(keys, return_inverse=True)
            counts.append(found[inverse])
        one, two = counts
        begins = np.r_[0, ends[:-1] + 1]
        state = np.empty_like(one)  # how often training has the state as a context
        state[1:] = one[:-1]
        state[begins] = one[ends]  # the start of a text occurs as often as END
        root = np.log10((one + add) / (n + add * (v + 1)))
        fail = np.where(state > 0, np.log10(strength / (state + strength)), 0.0)
        arc = np.log10((two + strength * 10.0**root) / (state + strength))
        step = np.where((state > 0) & (two > 0), arc, fail + root)
        return pa.table(
            {
                "i": table["i"],
                "train": table["train"],
                "n_tokens": pa.array(np.diff(np.r_[-1, ends]), pa.int64()),
                "n_known": pa.array(np.add.reduceat((one > 0).astype(np.int64), begins), pa.int64()),
                "base_score": np.add.reduceat(root, begins),
                "score": np.add.reduceat(step, begins),
            }
        )

    return run


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, strength: float = 20.0) -> DataFrame:
    """(i, train, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train: which rows the model learns from.  Tokens are 64-bit hashes of the folded words.  One job
    counts the training vocabulary.  A second deals documents into groups of about GROUP_BYTES; each
    group sends its distinct n-grams, by key range, to be summed over the corpus and gets back the
    part of the automaton that its texts can reach, so no task or driver holds the whole model.
    The counts cover all training rows without pruning.

    A null or empty text has the one token END.  Rows that repeat an id are scored, and learnt from,
    each.  With no training rows every token has the weight of an unknown one.
    """
    rows = text_rows(docs, id_col, text_col, train=F.coalesce(train, F.lit(False)))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = staged(_vocabulary(rows.select("text", "train"), parts), "vocabulary").agg(F.sum("n"), F.sum("v"), F.sum("nbytes")).first()
    n, v, nbytes = (int(x or 0) for x in size)
    groups = max(1, -(-nbytes // GROUP_BYTES))
    parts = max(1, -(-nbytes // 5 // PART_KEYS))
    dealt = rows.select(F.pmod("k", F.lit(groups)).cast("int").alias("g"), id_out().alias("i"), "train", "text").repartition(groups, "g")
    sent = dealt.groupBy("g").applyInArrow(_sent(parts), "p int, g int, kind int, keys binary, type string, counts binary")
    replies = sent.groupBy("p", "kind").applyInArrow(_totals, "g int, p int, kind int, type string, counts binary")
    out = dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(
        _scored(n, v, add, strength), "i long, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    return lm_scores(docs, kept).select(
        F.col("i").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
