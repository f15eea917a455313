"""The whole pipeline, and near-duplicates and line templates within it, against plain Python on a small corpus."""

import math
import re
import sys
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.llm import quality  # noqa: E402

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def good(docs, labels, grams):
    """(doc_id, text) rows that the first stage keeps."""
    by = defaultdict(list)
    for i, q, t in labels:
        by[i].append((q, t))
    trusted = {i for i, v in by.items() if min(q for q, _ in v) == 1 and max(t for _, t in v) == 0}
    raw, side = Counter(), Counter()
    for i, text in docs:
        raw.update(grams[text])
        if i in trusted:
            side.update(grams[text])
    share = lambda b: (raw[b] + 1) / (raw.total() + quality.BUCKETS)
    for i, text in docs:
        w, own = words(text), Counter(grams[text]) if i in trusted else Counter()
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        if len(w) < 20 or 100 * len(hit) > 30 * len(w):
            continue
        weights = [math.log((side[b] - own[b] + quality.PRIOR * share(b)) / ((side.total() - own.total() + quality.PRIOR) * share(b))) for b in grams[text]]
        if sum(weights) / len(weights) >= quality.LEAST_SCORE:
            yield i, text


def without_templates(docs):
    need = lambda n: min(10, max(2, 10 - (n - 10) // 5))
    lines, where = defaultdict(set), defaultdict(list)
    for i, text in docs:
        for at, line in enumerate(text.split("\n")):
            if w := tuple("<*>" if re.search("[0-9]", x) else x for x in words(line)):
                lines[len(w), w[:4]].add((w, i))
                where[w].append((i, at))
    seed = {}
    for (n, _), found in lines.items():
        docs_of = defaultdict(set)
        for w, i in found:
            docs_of[w].add(i)
        if len({i for _, i in found}) < need(n):
            continue
        if all(len(d) >= need(n) for d in docs_of.values()):
            seed |= {w: w for w in docs_of}
            continue
        support = Counter()
        for w, d in docs_of.items():
            support.update({(j, w[j]): len(d) for j in range(4, n)})
        chain = {}
        for w in docs_of:
            own = {(j, w[j]): support[j, w[j]] for j in range(4, n) if support[j, w[j]] >= need(n)}
            for level in set(own.values()) if n > 4 else {0}:
                kept = frozenset(k for k, s in own.items() if s >= level)
                m = len(kept) + min(n, 4)
                if 10 * m >= 7 * n:
                    chain.setdefault(kept, (m, set()))[1].add(w)
        best = {}
        for kept, (m, ws) in chain.items():
            enough = need(n) if n <= 4 or 10 * m >= 9 * n else 10
            if len(set().union(*(docs_of[w] for w in ws))) >= enough:
                total = sum(len(docs_of[w]) for w in ws)
                for w in ws:
                    best[w] = max(best.get(w, (0, 0, None)), (total, m, kept), key=lambda x: x[:2])
        seed |= {w: (n, w[:4], kept) for w, (_, _, kept) in best.items()}
    first, gone = {}, set()
    for w, s in seed.items():
        for i, _ in where[w]:
            first[s] = min(first.get(s, i), i)
    for w, s in seed.items():
        gone |= {(i, at) for i, at in where[w] if i != first[s]}
    for i, text in docs:
        left = [line for at, line in enumerate(text.split("\n")) if (i, at) not in gone]
        if len(left) == len(text.split("\n")) or len(words("\n".join(left))) >= 20:
            yield i, "\n".join(left)


def one_of_each(docs, n=5, share=80):
    sets = {}
    for i, text in docs:
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return [(i, t) for i, t in docs if top(i) == i]


def clean(docs, items):
    part = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for text in items:
        v = part(text)
        m = min(13, len(v))
        windows |= {tuple(v[s : s + m]) for s in range(len(v) - m + 1)} if m else set()
    sizes = {len(x) for x in windows}
    for i, text in docs:
        w = part(text)
        hit = {p for m in sizes for s in range(len(w) - m + 1) if tuple(w[s : s + m]) in windows for p in range(s, s + m)}
        if not (hit and 20 * len(hit) >= len(w)):
            yield i, text


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest documents table, with near copies, a template, a repeated passage and benchmark items put in."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    long = [t for _, t in docs if len(words(t)) > 150][:12]
    passage = " ".join(words(long[0])[:70])
    docs += [(1000 + n, t + f" tail {n}") for n, t in enumerate(long)]
    docs += [(1100 + n, f"Seen by {w} on the board of page {n}\n{t}\n{w} says so") for n, (t, w) in enumerate(zip(long, ["ann", "ann", "bob", "cy", "dee", "ed", "flo", "gus", "hal", "ida", "jo", "kit"], strict=True))]
    docs += [(1200 + n, f"{passage}\n{t[::-1]}") for n, t in enumerate(long[:3])]
    docs += [(1300 + n, f"{t}\n{item}") for n, (t, item) in enumerate(zip(long, items, strict=False))] + [(1400, items[0]), (1401, None), (1402, "")]
    frame = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), docs


def test_pipeline_rows(spark, corpus):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    found = frame.select("text", quality.n_grams(quality.word_hashes(quality.space_words(F.col("text"))), quality.BUCKETS).alias("g")).collect()
    grams = {r.text: r.g or [] for r in found}
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want, left = docs, frame
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (lambda d: good(d, labels, grams), without_templates, one_of_each, lambda d: clean(d, items)), strict=True):
        want, left = list(plain(want)), stage(spark, left, folder)
        assert sorted((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()) == sorted(want), name
    assert 20 < len(want) < len(docs) - 20
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == sizes
    assert {i: sum(r.length for r in out if r.doc_id == i) for i in sizes} == sizes
    places = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in out)
    assert [p for p, _ in places] == [sum(n for _, n in places[:j]) for j in range(len(places))]
