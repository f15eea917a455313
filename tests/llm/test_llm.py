"""Corpus operators against brute force, on small and awkward tables."""

import math
import struct
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.llm import decontaminate, line_templates, lm_score, minhash, packing, quality, registry, suffix_dedup, tool_calls, url_lists, warc  # noqa: E402

LONG = " ".join(f"word{n}" for n in range(400))
TEXTS = [
    (1, LONG), (2, LONG + " more"), (3, LONG), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (9, "two words"), (None, LONG), (None, None),
    (10, "é" * 3000), (11, "ab" * 900), (12, "x y z " * 60), (13, LONG[:700] + " tail"), (1, LONG), (14, "a\nb\na\n" + LONG), (2**40, "<|endoftext|> É k ü"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", t) for i, t in TEXTS], "doc_id long, text string, n_words string, k string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = packing.packed(docs, path, length=64).collect()
    want = Counter((i, tuple(tk.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in TEXTS)
    ends, by = {}, {}
    for r in rows:
        assert r.offset + r.length <= 64 and len(r.ids) == 4 * r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault((r.i, r.k, r.sequence_id * 64 + r.offset - r.start), []).append((r.start, struct.unpack(f"<{r.length}I", r.ids)))
    got = Counter((None if i == 2**63 - 1 else i, tuple(x for _, ids in sorted(v) for x in ids)) for (i, _, _), v in by.items())
    assert got == want
    for s, v in ends.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or s == max(ends)
    assert packing.packed(none, path).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        w = (r.text or "").split() if (r.text or "").isascii() else (r.text or "").split(" ")
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert r.n_repeat_words == len(hit) and r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert next(r.n_dup_lines for r in got if r.doc_id == 14) == 1
    assert quality.scored(none, labels.limit(0)).count() == 0


def test_quality_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 0), (14, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = F.col("text"), quality.n_grams(quality.word_hashes(quality.space_words(F.col("text"))), quality.BUCKETS).alias("grams")
    grams = {r.text: r.grams or [] for r in docs.select(*found).collect()}
    raw, chosen = Counter(), {(i, t) for i, t in TEXTS if i in (1, 2)}
    for _, t in TEXTS:
        raw.update(grams[t])
    good = sum((Counter(grams[t]) for _, t in chosen), Counter())
    for r in quality.scored(docs, labels).select("doc_id", "text", "quality.*").collect():
        own = Counter(grams[r.text]) if (r.doc_id, r.text) in chosen else Counter()
        share = lambda b: (raw[b] + 1) / (raw.total() + quality.BUCKETS)
        w = [math.log((good[b] - own[b] + quality.PRIOR * share(b)) / ((good.total() - own.total() + quality.PRIOR) * share(b))) for b in grams[r.text]]
        assert (r.score is None) == (not w) and (not w or abs(r.score - sum(w) / len(w)) < 1e-9)
        assert r.kept == (not r.base_failed and bool(w) and sum(w) / len(w) >= quality.LEAST_SCORE)


def test_quality_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("doc_id")
    for some in (labels.limit(0), labels, labels.join(clean.orderBy("doc_id").limit(20), "doc_id")):
        passed = quality.scored(docs, some).join(clean, "doc_id", "left_semi").select("quality.*").filter("not base_failed")
        assert passed.filter("kept").count() >= 0.95 * passed.count() > 0


def test_url_lists(spark):
    ts = lambda d: f"timestamp'2024-01-{d:02d}'"
    entries = spark.sql(f"select * from values ('a.org', {ts(2)}, true), ('a.org', {ts(20)}, false), ('a.org', {ts(20)}, true), ('x.b.org', {ts(5)}, true), ('x.b.org', {ts(9)}, false), (null, {ts(1)}, true) as t(key, at, listed)")
    caps = spark.sql(f"select * from values (1, 'http://q.a.org/', {ts(1)}), (2, 'http://q.a.org/', {ts(2)}), (3, 'http://a.org/', {ts(30)}), (4, 'http://x.b.org/', {ts(8)}), (5, 'http://x.b.org/', {ts(9)}), (6, null, {ts(9)}), (7, 'nothing', {ts(9)}), (2, 'http://q.a.org/', {ts(2)}) as t(id, url, at)")
    got = sorted((r.id, r.blocked) for r in url_lists.filtered(caps, entries).collect())
    assert got == [(1, False), (2, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False)]
    assert url_lists.filtered(caps, entries.limit(0)).filter("blocked").count() == 0
    assert url_lists.filtered(caps.limit(0), entries).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "search", '{"limit":3,"query":"q"}', "c"), (1, "b", 1, "search", '{"limit":0,"query":"q"}', "a"), (1, "c", 2, "lookup", "{", None), (1, "c", 2, "lookup", "{", None),
         (2, "x", 0, "draw", "{}", "y"), (2, "y", 1, "lookup", '{"query":"é"}', "x"), (2, "z", 2, None, None, "gone"), (None, "n", 0, "lookup", "{}", None)],
        "conv long, call string, turn long, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "first"), (9, "a", 1, "lost")], "conv long, call string, turn long, content string")
    got = {(r.conv, r.call): r for r in tool_calls.linked(calls, results, tool_calls.SCHEMAS).collect()}
    assert {k: r.depth for k, r in got.items()} == {(1, "c"): 0, (1, "a"): 1, (1, "b"): 2, (2, "x"): None, (2, "y"): None, (2, "z"): 0}
    assert got[1, "a"].fault is None and got[1, "b"].fault == "range of limit" and got[1, "c"].fault == "not JSON" and got[2, "x"].fault == "unknown tool"
    assert got[1, "a"].record == '{"after":"c","arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":{"content":"first"}}'
    assert tool_calls.linked(calls.limit(0), results, tool_calls.SCHEMAS).count() == 0


def test_suffix_levels(docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    got = Counter()
    for r in suffix_dedup.repeated_spans(docs, length=100).collect():
        got[None if r.i == 2**63 - 1 else r.i, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)] += 1
    seen = Counter(b[i : i + 100] for _, t in TEXTS for b in [(t or "").encode()] for i in range(len(b) - 99))
    want = Counter()
    for i, t in TEXTS:
        b, m = (t or "").encode(), set()
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] > 1:
                m.update(range(s, s + 100))
        edge = [p for p in range(len(b) + 1) if (p in m) != (p - 1 in m)]
        want[i, len(b), bytes(c for p, c in enumerate(b) if p not in m), tuple(zip(edge[::2], edge[1::2], strict=True))] += 1
    assert got == want
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_warc(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", tricky), (6, "u", "WARC/1.1\r\n" * 3), (7, "u", "é" * 50000)], "page_id long, url string, html string")
    for n, frame in enumerate((pages, pages.limit(0))):
        folder = str(tmp_path / str(n))
        warc.write_archives(frame, folder)
        got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder).collect()}
        assert got == ({1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, len(tricky)), 6: ("response", None, 30), 7: ("response", None, 100000)} if n == 0 else {})


def test_line_templates(spark):
    rows = [(n, f"Posted by user{n} on the board today at noon\nOwn text number {'xyz'[n % 3] * (n + 1)} of this\n{chr(97 + n)} tail") for n in range(12)]
    frame = spark.createDataFrame([*rows, (50, None), (51, ""), (52, "\n\n"), (None, "Posted by user1 on the board today at noon")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.without_templates(frame).collect()}
    assert got[0].text == rows[0][1] and all("Posted" not in got[n].text and "tail" in got[n].text for n in range(1, 12))
    assert got[50].text is None and got[51].text == "" and got[52].text == "\n\n" and got[None].text == ""
    made = line_templates.templates(frame).collect()
    assert [r.template for r in made] == ["Posted by <*> on the board today at noon"]
    assert line_templates.without_templates(frame.limit(0)).count() == 0


def test_line_templates_long(spark):
    passage = " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(60))
    other = " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}z" for n in range(30))
    texts = [f"{passage}\n{other}\n{chr(97 + n)} tail" for n in range(5)] + [f"{other}\n{chr(97 + n)} tail" for n in range(5, 6)]
    frame = spark.createDataFrame([*enumerate(texts[:3]), (7, passage.replace("ab", "changed", 1))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_templates(frame).collect()}
    assert got == {0: texts[0], 1: f"{other}\nb tail", 2: f"{other}\nc tail", 7: ""}  # 30 words need 6 documents
    got = {r.doc_id: r.text for r in line_templates.without_templates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0]} | {n: f"{chr(97 + n)} tail" for n in range(1, 6)}


def test_line_templates_failed_seed(spark):
    again = "one two three four echo echo echo echo"
    rows = [(0, "\n".join([again] * 1000)), *((n, f"one two three four mine yours ours theirs\n{chr(97 + n)} tail") for n in range(1, 13))]
    rows += [(20 + n, f"one two three four nine nine nine nine\n{chr(97 + n)} tail") for n in range(9)]
    rows += [(40 + n, f"one two three four red green blue {'xyz'[n % 3]}\n{chr(97 + n)} tail") for n in range(12)]
    # eleven texts in a document each, fewer than the seed above, which fails
    rows += [(60 + n, f"one two three four left right {chr(97 + n) * 3} end") for n in range(11)]
    got = {r.doc_id: r.text for r in line_templates.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = dict(rows)
    for n in [*range(2, 13), *range(41, 52)]:
        kept[n] = kept[n].split("\n")[1]
    assert got == kept | {n: "" for n in range(61, 71)}


def test_decontamination(spark):
    import re

    base = [f"w{n}" for n in range(60)]
    items = [("i1", " ".join(base[:30])), ("i2", "Tiny ITEM"), ("i3", None), ("i4", "..."), ("i5", " ".join(base[10:23])), ("i6", "Été à"), ("i1", " ".join(base[:30])), (None, " ".join(base[40:55]))]
    texts = [(1, " ".join(base)), (2, "a tiny item, here"), (3, " ".join(base[5:17])), (4, None), (5, ""), (6, "été à"), (7, "Été À"), (8, ", ".join(base[:13]).upper()), (8, "x " * 3000 + " ".join(base[12:40])), (None, "TINY item")]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = Counter((None if r.i == 2**63 - 1 else r.i, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.overlaps(frame, bench).collect())
    want = Counter()
    for i, t in texts:
        w, hit, who = words(t), set(), set()
        for name, text in items:
            v = words(text)
            m = min(13, len(v))
            for s in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[s : s + m]:
                        hit.update(range(p, p + m))
                        who |= {name} - {None}
        want[i, len(w), len(hit), tuple(sorted(who))] += 1
    assert got == want
    assert decontaminate.overlaps(frame, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_sigma(spark):
    items = [("i1", "Σ"), ("i2", "ΟΔΟΣ αβγ"), ("i3", " ".join(f"ΛΟΓΟΣ{n}Σ" for n in range(13)))]
    texts = [(1, "Α.Σ"), (2, "x ΟΔΟΣ.αβγ y"), (3, ".Α'".join(f"ΛΟΓΟΣ{n}Σ" for n in range(13))), (4, ".".join(f"ΛΟΓΟΣ{n}Σ" for n in range(13)) + ".Α"), (5, "οδος αβγ")]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.i: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == {1: (2, 1, ["i1"]), 2: (4, 2, ["i2"]), 3: (25, 0, []), 4: (14, 13, ["i3"]), 5: (2, 0, [])}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates(docs, none, monkeypatch):
    for name, value in (("BLOCK_DOCS", 2), ("SIG_DOCS", 2), ("SMALL", 2)):
        monkeypatch.setattr(minhash, name, value)
    ids = [(2**63 - 1 if i is None else i, shingles(t, 3)) for i, t in TEXTS]
    up = list(range(len(ids)))
    for _ in ids:
        for a, b in combinations(range(len(ids)), 2):
            x, y = ids[a][1], ids[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[a] = up[b] = min(up[a], up[b])
    least = {g: min(ids[j][0] for j in range(len(ids)) if up[j] == g) for g in set(up)}
    want = Counter((i, len(s), least[up[n]] if s else i) for n, (i, s) in enumerate(ids))
    assert Counter((r.i, r.n, r.component) for r in minhash.near_duplicates(docs).collect()) == want
    assert minhash.near_duplicates(none).count() == 0


def test_lm_scores(docs, none, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 2000)
    monkeypatch.setattr(lm_score, "PART_KEYS", 100)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    toks = [(i, (t or "").encode().lower().split() + [0]) for i, t in TEXTS]
    c, b, n = Counter(), Counter(), 0
    for (i, _), (_, w) in zip(TEXTS, toks, strict=True):
        if (i or 0) % 3:
            c.update(w), b.update(zip([1, *w], w, strict=False))
            n += len(w)
    p = lambda x: (c[x] + 0.1) / (n + 0.1 * (len(c) + 1))
    want = []
    for i, w in toks:
        s = 0.0
        for u, x in zip([1, *w], w, strict=False):
            cu = c[0] if u == 1 else c[u]
            s += math.log10((b[u, x] + 20 * p(x)) / (cu + 20)) if cu else math.log10(p(x))
        want.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(s, 6)))
    got = lm_score.lm_scores(docs, train).collect()
    assert Counter((r.i, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == Counter(want)
    assert lm_score.lm_scores(none, train).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE[name])
    cols = [x[0] for x in found.description]
    want = sorted(repr([r[cols.index(x)] for x in sorted(cols)]) for r in found.fetchall())
    assert sorted(repr([r[x] for x in sorted(cols)]) for r in df.collect()) == want
