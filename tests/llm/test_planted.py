"""Passages that repeat across documents, cut by op5's query, against a plain count of every 400-byte string."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402

from tidewheel.llm import suffix_dedup  # noqa: E402

LENGTH = 400


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdeéou", k=draw.randint(2, 9))) for _ in range(n))


def planted():
    """Texts by doc_id, the passages that were put into them, and the documents that hold text of their own only."""
    draw, texts, passages, clean = random.Random(5), {}, {}, []
    own = lambda: prose(draw, draw.randint(60, 300))
    for j in range(24):
        passage = " ".join("abcdefghij"[draw.randrange(10)] * (2 if j % 3 else 8) for _ in range(draw.randint(51, 130)))
        for k in range(2 + j % 4):
            i = 100 * j + k
            texts[i], passages[i] = (own() + "\n") * (k > 0) + passage + (" " if k % 2 else "\n") + own(), passage
    for i in range(9000, 9060):
        texts[i] = own()
        clean.append(i)
    edge = "".join(draw.choices("klmnopqr", k=400))
    texts |= {9100: "1" + edge + "2", 9101: "3" + edge + "4", 9102: "5" + edge[:399] + "6", 9103: "", 9104: None, 9105: "ab" * 700, 9106: edge[:399]}
    texts |= {9107: texts[9000] + "\n" + own(), 9108: "é" * 500}
    clean.remove(9000)
    return texts, passages, clean


def counted(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) by doc_id, as the contract says."""
    whole = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(b[s : s + LENGTH]) for b in whole.values() for s in range(len(b) - LENGTH + 1))
    out = {}
    for i, b in whole.items():
        gone = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if seen[hash(b[s : s + LENGTH])] > 1:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), sum(gone), sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False)), hashlib.sha256(kept).hexdigest()
    return out


def cut(spark, d):
    rows = suffix_dedup.op5_suffix_dedup(spark, d).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("group", [suffix_dedup.GROUP_BYTES, 3000])
def test_planted_passages(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    texts, passages, clean = planted()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = cut(spark, str(tmp_path))
    assert got == counted(texts)
    long = {i for i, p in passages.items() if len(p) >= LENGTH}
    assert long and len(long) < len(passages)
    assert all(got[i][1] >= len(passages[i]) for i in long)  # caught
    assert all(got[i][1] == 0 for i in passages if i not in long)  # over 50 words, under 400 bytes: the contract keeps them
    assert all(got[i][1:3] == (0, 0) for i in clean)  # left alone


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = counted({r.doc_id: r.text for r in rows})
    assert cut(spark, SF) == want
    assert sum(n for _, n, _, _ in want.values()) > 0
