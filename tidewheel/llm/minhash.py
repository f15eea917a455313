"""Near-duplicate groups: banded MinHash candidates, b-bit estimates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, Prefix, mix, slices, words
from .common import components, discard, id_out, missing_id, small, staged, text_rows

PERMS, ROWS, BITS = 128, 5, 2
BANDS = PERMS // ROWS
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
SIG_DOCS, SMALL, FIRST = 2048, 64, 3


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles."""
    for lo, hi, buf, offs in slices(column):
        s, e, first = words(buf, offs)
        h = Prefix(buf, fold=True).span(s, e)
        n = max(0, len(h) - size + 1)
        c = np.zeros(n, U)
        for j in range(size):
            c = mix(c * U(0x2545F4914F6CDD1D) + h[j : j + n])
        for d in range(hi - lo):
            a, z = int(first[d]), int(first[d + 1])
            if z - a >= size:
                yield np.unique(c[a : z - size + 1])
            elif z > a:  # fewer words: the whole sequence is one shingle
                yield np.array([xxhash.xxh3_64_intdigest(h[a:z].tobytes(), seed=z - a)], U)
            else:
                yield np.zeros(0, U)


def _signer():
    rnd = np.random.RandomState(7)
    mul = (rnd.randint(0, 2**31, PERMS) * 2 + 1).astype(np.uint32)
    add = rnd.randint(0, 2**31, PERMS).astype(np.uint32)
    step = (rnd.randint(0, 2**62, ROWS) * 2 + 1).astype(U)
    shift = U(BITS) * np.arange(64 // BITS, dtype=U)

    def sign(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed low bits of the minima, and the hash of each band of minima."""
        x = (hashes ^ (hashes >> U(32))).astype(np.uint32)
        low = np.full(PERMS, 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (x[at : at + 2048, None] * mul + add).min(0), out=low)
        wide = low.astype(U)
        band = mix((wide[: BANDS * ROWS].reshape(BANDS, ROWS) * step).sum(1, dtype=U) + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))
        bits = mix(wide) & U(2**BITS - 1)
        return (bits.reshape(-1, 64 // BITS) << shift).sum(1, dtype=U).tobytes(), band.view(np.int64)

    return sign


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """(i, k, n, node, sig, bands) for each row of text_rows(); node names the shingle set."""

    def run(batches):
        sign = _signer()
        for batch in batches:
            n, node, sig, bands, seen = [], [], [], [], {}
            for h in shingle_sets(batch.column("text"), size):
                n.append(len(h))
                if not len(h):
                    node.append(None), sig.append(None), bands.append(None)
                    continue
                key = xxhash.xxh3_128_digest(h.tobytes())
                if key not in seen:
                    seen[key] = sign(h)
                node.append(key), sig.append(seen[key][0]), bands.append(seen[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("k"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["i", "k", "n", "node", "sig", "bands"],
            )

    return rows.mapInArrow(run, "i long, k long, n long, node binary, sig binary, bands array<long>")


def _estimates(threshold: int, margin: float):
    """(x, others, table columns) -> which of the others' signatures are near enough to x's, and how many bits apart they are."""
    chance = 0.5**BITS
    least = (threshold / 100 - margin) * (1 - chance) + chance  # collision-corrected: share of equal bits to expect
    most_apart = PERMS * (1 - least)
    odd = U(int("01" * 32, 2))

    def near(sig: np.ndarray, n: np.ndarray, x: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = sig[x] ^ sig[to]
        apart = np.bitwise_count((d | (d >> U(1))) & odd).sum(1)
        return (apart <= most_apart) & (100 * np.minimum(n[x], n[to]) >= threshold * np.maximum(n[x], n[to])), apart

    return near


def _sides(table: pa.Table):
    """Each row of the first block with the rows of the second that it is to be compared with."""
    block, a, b = table["block"].to_numpy(), table["a"][0].as_py(), table["b"][0].as_py()
    right = np.arange(len(block)) if a == b else np.flatnonzero(block == b)
    for x in range(len(block)) if a == b else np.flatnonzero(block == a):
        yield x, right[right > x] if a == b else right


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), U).reshape(len(table), -1)


def _hopeful(threshold: int, margin: float):
    near = _estimates(threshold, margin)

    def run(table: pa.Table) -> pa.Table:
        """The nodes of a block pair that some other's signature is near."""
        sig, n, some = _signatures(table), table["n"].to_numpy(), np.zeros(len(table), bool)
        for x, to in _sides(table):
            ok, _ = near(sig, n, x, to)
            some[to[ok]] = True
            some[x] |= bool(ok.any())
        return table.select(["band", "node"]).filter(pa.array(some))

    return run


def _pairs_in_block(threshold: int, margin: float, size: int):
    near = _estimates(threshold, margin)

    def run(table: pa.Table) -> pa.Table:
        """Links found between block a and block b of one bucket: enough of them to join what is linked."""
        nodes, sig, n = table["node"].to_pylist(), _signatures(table), table["n"].to_numpy()
        sets = list(shingle_sets(table["text"], size))
        up, a, b = list(range(len(sets))), [], []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, to in _sides(table):
            ok, apart = near(sig, n, x, to)
            for y in to[ok][np.argsort(apart[ok], kind="stable")]:
                if top(x) == top(y):
                    continue
                both = np.concatenate([sets[x], sets[y]])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= threshold * (n[x] + n[y] - inter):
                    up[top(x)] = top(y)
                    a.append(nodes[x]), b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _block_pairs(members: DataFrame, blocks: Column) -> DataFrame:
    """members (band, node, ...) dealt out as pairs of blocks (a, b) of their band's bucket."""
    m = members.withColumn("m", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return other.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "m")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 85, margin: float = 0.23) -> DataFrame:
    """(i, k, n, component, lost) for each row: component is the least id linked with it, itself included; lost is 1 if that has none.

    Texts are linked when their word-shingle sets have a Jaccard similarity of threshold percent.
    1. Rows with the same shingle set become one node, so a group of exact copies costs one node.
    2. 25 bands of 5 minima; nodes that meet in a band share its bucket, and only such are compared: a pair at the threshold shares no band
       with probability below 1e-6.  Buckets with the same nodes are looked at once.
    3. In buckets of more than SMALL nodes, dealt out as pairs of blocks of at most SIG_DOCS nodes, 2-bit signatures alone are compared
       by bit counts; nodes with no other above the threshold less `margin` (six standard deviations) leave the bucket.
    4. What is left is dealt out, with the texts, as pairs of blocks of at most BLOCK_DOCS nodes or BLOCK_SHINGLES shingles.  Pairs
       near enough by signature and not joined yet are confirmed on full sets, so m near copies give m - 1 links and not all pairs.
    5. The buckets of the first FIRST bands come first; of the others those are left out whose nodes these have joined already.
       Components of the confirmed links.

    Texts without words (null, empty, blank) have n = 0 and are their own component.  Rows without
    an id come last in the order.  Rows that repeat an id and text are one node.
    """
    rows = text_rows(docs, id_col, text_col)
    drawn = staged(sketches(rows, size), "sketch")
    nodes = drawn.filter("n > 0").groupBy("node").agg(F.min(F.struct("i", missing_id().alias("lost"), "k", "n", "sig", "bands")).alias("r"))
    nodes = staged(nodes.select("node", "r.*"), "nodes")
    met = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    buckets = met.groupBy("at", "band").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("c > 1")
    buckets = staged(buckets.groupBy("c", "x", "y").agg(F.min(F.struct("at", "band")).alias("b")).select("c", "b.*"), "buckets")
    # the texts of nodes that share a bucket with any other: one pass over all texts, whatever the number of buckets
    shared = staged(nodes.join(met.join(buckets, ["at", "band"]).select("node").distinct(), "node").select("node", "i", "k", "n", "sig"), "shared")
    texts = staged(rows.join(small(shared), ["i", "k"]).dropDuplicates(["node"]).select("node", "n", "sig", "text"), "texts")

    def links(members: DataFrame) -> DataFrame:
        """(a, b): confirmed links within the buckets of members (band, c, node)."""
        large = _block_pairs(members.filter(F.col("c") > SMALL).join(shared.select("node", "n", "sig"), "node"), F.ceil(F.col("c") / SIG_DOCS))
        kept = large.select("band", "a", "b", "block", "node", "n", "sig").groupBy("band", "a", "b").applyInArrow(_hopeful(threshold, margin), "band long, node binary").distinct()
        left = staged(members.filter(F.col("c") <= SMALL).select("band", "node").unionByName(kept), "members")
        blocks = left.join(shared.select("node", "n"), "node").groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = _block_pairs(left.join(blocks, "band"), F.col("blocks")).join(texts, "node").select("band", "a", "b", "block", "node", "n", "sig", "text")
        out = staged(dealt.groupBy("band", "a", "b").applyInArrow(_pairs_in_block(threshold, margin, size), "a binary, b binary"), "links")
        discard(left)
        return out

    def members(some: Column) -> DataFrame:
        return met.join(buckets.filter(some), ["at", "band"]).select("band", "c", "node")

    first = links(members(F.col("at") < FIRST))
    label = components(first)
    later = staged(members(F.col("at") >= FIRST).join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "later")
    apart = later.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    second = links(later.drop("label").join(apart, "band", "left_semi"))
    joined = components(first.union(second))
    of_node = nodes.select("node", "i", "lost").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min(F.struct("i", "lost")).alias("least"))
    known = staged(of_node.join(least, "label").select("node", F.col("least.i").alias("component"), F.col("least.lost").alias("lost")), "known")
    for done in (buckets, shared, texts, first, label, later, second, joined, nodes):
        discard(done)
    return drawn.select("i", "k", "n", "node").join(known, "node", "left").select("i", "k", "n", F.coalesce("component", "i").alias("component"), F.coalesce("lost", missing_id()).alias("lost"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose component has a row with a smaller id.  Columns as in docs."""
    from .common import with_key

    found = near_duplicates(docs, id_col, text_col, **how).filter((F.col("i") == F.col("component")) & (missing_id() == F.col("lost"))).select("i", "k").distinct()
    return with_key(docs, found, "left_semi", id_col, text_col).select(*(f"`{c}`" for c in docs.columns))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        id_out().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        id_out("component", "lost").alias("component_id"),
        ((F.col("i") == F.col("component")) & (missing_id() == F.col("lost"))).alias("kept"),
    )
