"""Merkle manifest, periodic runs and byte-level BPE against plain Python, on the given tables and on odd rows."""

import hashlib
import random
import sys
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.llm import byte_bpe, merkle, periodic_runs  # noqa: E402
from tidewheel.llm.registry import QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_i int, K string, digest string"
H = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with a documents table of odd rows, and one with an empty table."""
    rows = [
        (None, "no id", "en", None, None), (None, None, None, None, None), (5, "", "", "web", 0), (5, "", "", "web", 0), (5, "other", "en", "x", 5), (2**63 - 1, "largest", "en", "x", 7), (-7, "a b " * 400, "de", "s", 1600),
        *[(100 + j, f"Row {j} of some, " + "la la la la la la " * (j % 4) + "ÄÖ  x", random.Random(j).choice(["en", "fr", None, "é", "z"]), "w" * (j % 3), j) for j in range(90)],
        (1000, "\U00011de0 ՘x \x1f\x0b end\n\n\n  tail ", "one", "s", 3), (1001, "x" * 5000 + " " * 5000 + "=-" * 3000, "en", "s", 3),
    ]
    full = [(i, t, lang, source, n, 1, "k", "d") for i, t, lang, source, n in rows]
    out = {}
    for name, data in (("odd", full), ("empty", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{out[name]}/documents.parquet")
    return out


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()


def folders(odd):
    return [SF, odd["odd"], odd["empty"]]


def same(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# --- 11 --------------------------------------------------------------------------------------------


def fold_up(level):
    """Levels of (digest) from the leaves up."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][j : j + 8])) for j in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    for level in levels[:-1]:
        lo = at // 8 * 8
        yield level[lo:at], level[at + 1 : lo + 8]
        at //= 8


def merkle_rows(docs):
    enc = lambda x: b"-" if x is None else f"{len(str(x).encode())}:{x}".encode()
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(b"".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    by = {}
    for r in docs:
        by.setdefault(r.lang, []).append(r)
    trees = {}
    for lang in by:
        by[lang].sort(key=lambda r: (first(r.doc_id), leaf(r, r.text)))
        trees[lang] = fold_up([leaf(r, r.text) for r in by[lang]])
    langs = sorted(by, key=first)
    top = fold_up([trees[x][-1][0] for x in langs]) if langs else []
    for g, lang in enumerate(langs):
        for at, r in enumerate(by[lang]):
            steps = [*path(trees[lang], at), *path(top, g)]
            own = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 0
            now = leaf(r, lower(r.text) if own else r.text)
            for left, right in steps:
                now = H("".join(left) + now + "".join(right))
            proof = H("".join("".join(left) + "".join(right) for left, right in steps))
            yield r.doc_id, leaf(r, r.text), trees[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]


def test_merkle(spark, odd):
    for d in folders(odd):
        want = list(merkle_rows(documents(spark, d)))
        same(QUERIES["op11_merkle"](spark, d).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect(), want)
        assert not want or {x[-1] for x in want} == {True, False}


def test_merkle_nodes(spark):
    """Trees of 1, 8, 9, 65 and 513 leaves: nodes of a level cover the ranks without gaps, eight below each but the last."""
    sizes = {"a": 1, "b": 8, "c": 9, "d": 65, "e": 513}
    rows = spark.createDataFrame([(g, j) for g, n in sizes.items() for j in range(n)], "g string, o long").withColumn("leaf", F.unhex(F.sha2(F.concat("g", F.col("o").cast("string")).cast("binary"), 256)))
    leaves, nodes = merkle.manifest(rows, "g", ["o"])
    found = nodes.groupBy("tree", "level").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("x")).collect()
    spans = {(r.tree, r.level): [(x.lo, x.hi) for x in r.x] for r in found}
    for tree, n in enumerate(sizes.values()):
        level, span = 0, 1
        while True:
            assert spans[tree, level] == [(lo, min(n, lo + span) - 1) for lo in range(0, n, span)]
            if span >= n:
                break
            level, span = level + 1, span * 8
        assert (tree, level + 1) not in spans
    assert spans[-1, 1] == [(0, 4)]
    assert leaves.filter(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and leaves.count() == sum(sizes.values())


def test_merkle_sees_each_field(spark):
    """A change of any field, a null for an empty text and a swap of neighbours' texts are all seen."""
    rows = spark.createDataFrame([(j, f"text {j}", "en" if j % 2 else "de", "", j) for j in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    changes = {"text": F.lit("text 4"), "n_chars": F.col("n_chars") + 1, "source": F.lit(None).cast("string"), "lang": F.lit("d"), "doc_id": F.col("doc_id") + 100}
    for name, value in changes.items():
        found, _ = merkle.checked(rows, tamper=(F.col("doc_id") == 3, {name: value}))
        assert {r.doc_id for r in found.filter("folded_root <> root").collect()} == {3}, name


# --- 12 --------------------------------------------------------------------------------------------


def runs(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def run_rows(docs):
    for r in docs:
        w = (r.text or "").encode().split()
        n, h = len(w), 1 if r.doc_id is None else crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = sorted(runs(w), key=lambda x: (x[0], x[2]))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        s, m, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        yield r.doc_id, len(found), s, m, q, None if s is None else 1000 * m // q, H("".join(f"{a},{b},{c}\n" for a, b, c in found)), H(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs(spark, odd):
    for d in folders(odd):
        same(QUERIES["op12_periodic_runs"](spark, d).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect(), run_rows(documents(spark, d)))


def test_runs_of_many_sequences():
    rng = random.Random(4)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 120), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(k) for _ in range(n)]
            a, p = rng.randint(0, n), rng.randint(1, 12)
            texts.append([w[i] if i < a else w[a + (i - a) % p] for i in range(n)] if rng.random() < 0.5 else w)
        seq, begins = [], []
        for j, w in enumerate(texts):
            seq.append(1000 + j)
            begins.append(len(seq))
            seq += w
        got = periodic_runs.runs_of(np.array([*seq, 999]), max(map(len, texts)))
        assert [tuple(x) for x in got.tolist()] == [(b + s, n, q) for b, w in zip(begins, texts, strict=True) for s, n, q in sorted(runs(w), key=lambda x: (x[0], x[2]))]


def test_extension():
    """Common extensions of all pairs of places, by the cover and the table, and over lengths about the cover's."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 12, 13, 14, 27, 80):
        seq = np.r_[rng.integers(0, 2, n), 9]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        i, j = i[i != j], j[i != j]
        want = [next(t for t in range(n + 2) if max(a, b) + t > n or seq[a + t] != seq[b + t]) for a, b in zip(i, j, strict=True)]
        assert periodic_runs.Extension(seq)(i, j).tolist() == want


def test_runs_of_a_long_text(spark):
    """A text of 200,000 words of one period and one of a single word; periods as long as a quarter of the text are found."""
    texts = ["head " + " ".join(f"w{j % 50000}" for j in range(200_000)), "so " * 200_000]
    rows = periodic_runs.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("i").collect()
    assert [[tuple(x) for x in r.runs] for r in rows] == [[(1, 200_000, 50_000)], [(0, 200_000, 1)]]
    assert rows[1].collapsed == "so" and len(rows[0].collapsed.split()) == 50_001


# --- 13 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    names = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
    return {
        name: tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(name).read_bytes().splitlines())}, special_tokens={})
        for name in names
    }


def test_bpe(spark, odd, library):
    encode = next(iter(library.values())).encode_ordinary
    for d in folders(odd):
        want = []
        for r in documents(spark, d):
            ids = encode(r.text or "")
            want.append((r.doc_id, len(ids), H(" ".join(map(str, ids))), H(r.text or "")))
        same(QUERIES["op13_byte_bpe"](spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)


def test_bpe_of_odd_texts(library):
    import public_tokenizers as P

    rng = random.Random(6)
    kinds = ["abcdefgh", "aab", "the in on er an re ", " \n\t\r=-_", "éüñ中文🙂 ab1", "etaoinshrdlu", "՘\U00011de0\U000323b0 aé1"]
    texts = ["", " ", "a" * 1000, " " * 5000, "ab" * 3000, "é" * 999, "﻿‍", "1234567890" * 50, "=-=-" * 500, "\r\n\r\n  \t", "zzzyyzzyzyzyyyz" * 50, "中文没有空格" * 300]
    texts += ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["".join(rng.choice(k) for _ in range(2000)) for k in kinds]
    for path, model in library.items():
        ids, ends = byte_bpe.Encoder(path, P.PATTERN).encode(texts)
        for j, text in enumerate(texts):
            own = ids[ends[j] : ends[j + 1]]
            assert own.tolist() == model.encode_ordinary(text), text[:80]
            assert byte_bpe.vocabulary(path).decoded(own)[0].tobytes().decode() == text
    long, _ = byte_bpe.Encoder(path, P.PATTERN).encode([" " * 1_000_000])  # the library itself gives up on this one
    assert byte_bpe.vocabulary(path).decoded(long)[0].tobytes() == b" " * 1_000_000


def test_pieces_are_forgotten(library, monkeypatch):
    """Ids are the same whatever the number of pieces that a task remembers."""
    import public_tokenizers as P

    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 3)
    path, model = next(iter(library.items()))
    encoder = byte_bpe.Encoder(path, P.PATTERN)
    for text in ("some words here and there", "qzxv wwyq", "here and elsewhere", "some words"):
        assert encoder.encode([text])[0].tolist() == model.encode_ordinary(text)
    assert len(encoder.place) <= 8


def test_bpe_decodes_what_it_can(spark, library):
    path = next(iter(library))
    rows = [(1, 1, [0, 50255]), (2, 2, []), (3, 3, None), (4, 4, [7, 50256]), (5, 5, [-1]), (6, 6, [None]), (7, 7, [220, 220])]
    got = {r.i: r.bytes for r in byte_bpe.decoded(spark.createDataFrame(rows, "i long, k long, ids array<int>"), path).collect()}
    model = library[path]
    assert got == {1: bytearray(model.decode_bytes([0, 50255])), 2: bytearray(), 3: None, 4: None, 5: None, 6: None, 7: bytearray(b"  ")}
