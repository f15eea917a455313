"""Packing of token ids into sequences of one length by concatenation and cutting."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_out, staged, text_rows

SEQUENCE, CLOSE = 1024, 0
MOST_PARTITIONS = 1 << 20


def _encoder(path: str):
    """text -> array of the ids of the byte-level BPE file at path, by much the fastest encoder installed.

    Special tokens in a text are single ids, as in the tokenizers library's default.  A text that the encoder's pattern can't part, such
    as a million blanks, goes to the tokenizers library, which gives the same ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = json.load(open(path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    fast, slow = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: (i, k, part, before, n, ids), where before counts the ids of the partition's earlier rows."""

    def run(batches):
        encode, part, before = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids = encode(text.as_py() or "")
                out.append(np.append(ids, CLOSE).astype("<u4" if ids.max(initial=0) > 65535 else "<u2"))
            n = np.array([len(x) for x in out], np.int64)
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_pydict(
                {"i": batch.column("i"), "k": batch.column("k"), "part": pa.array([part] * len(n), pa.int32()), "before": start, "n": n, "ids": pa.array([x.tobytes() for x in out], pa.binary())}
            )

    rows = text_rows(docs, id_col, text_col)
    return staged(rows.mapInArrow(run, "i long, k long, part int, before long, n long, ids binary"), "tokens")


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """(i, k, start, length, doc_tokens, sequence_id, offset, ids), one row for each piece.

    All documents' ids, each document closed by id 0, are laid end to end and cut every `length` ids, so
    that only the last sequence needs padding.  The first pass writes ids with their place in the
    partition; running sums over the partitions' totals make the places global; the second pass cuts each
    document at multiples of `length`.  ids: little-endian unsigned 32-bit.

    The partition totals, one row for each partition of the written table, are broadcast up to
    MOST_PARTITIONS rows (16 MB) and joined by a shuffle beyond.  A null or empty text has the closing id alone.
    Rows that repeat an id are packed each.
    """
    tokens = tokenized(docs, path, id_col, text_col)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    totals = staged(totals, "totals")
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= MOST_PARTITIONS:
        bases = F.broadcast(bases)

    def run(batches):
        for batch in batches:
            cols = {x: [] for x in ("row", "start", "length", "sequence_id", "offset", "ids")}
            at, n, ids = batch.column("at").to_numpy(), batch.column("n").to_numpy(), batch.column("ids")
            for row in range(len(n)):
                blob, a, z = ids[row].as_py(), int(at[row]), int(at[row] + n[row])
                wide = np.frombuffer(blob, f"<u{len(blob) // (z - a)}").astype("<u4").tobytes()
                p = a
                while p < z:
                    q = min(z, (p // length + 1) * length)
                    for c, x in zip(cols.values(), (row, p - a, q - p, p // length, p % length, wide[4 * (p - a) : 4 * (q - a)]), strict=True):
                        c.append(x)
                    p = q
            row = pa.array(cols.pop("row"), pa.int64())
            blobs = pa.array(cols.pop("ids"), pa.binary())
            yield pa.RecordBatch.from_pydict(
                {"i": batch.column("i").take(row), "k": batch.column("k").take(row), "doc_tokens": batch.column("n").take(row)}
                | {c: pa.array(x, pa.int64()) for c, x in cols.items()}
                | {"ids": blobs}
            )

    placed = tokens.join(bases, "part").select("i", "k", "n", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(run, "i long, k long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")


def packed_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return packed(docs, path).select(
        id_out().alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
