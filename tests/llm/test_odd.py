"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every corpus operator and pipeline stage."""

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.llm import common, decontaminate, line_templates, lm_score, minhash, packing, quality, suffix_dedup, tool_calls, url_lists, warc  # noqa: E402

HUGE = "word and more of it " * 100_000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, HUGE), (4, HUGE), (5, HUGE + "tail"), (6, "x" * 700_000), (None, "no id"), (None, "no id"), (7, "same line\nsame line"), (7, "same line\nsame line"), (None, None)]
NAMES = ["Quality", "Lines_Dropped", "ROW_I", "k", "N", "seed", "lang"]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that the operators use, in another case."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.withColumns({n: F.lit(n) for n in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "no id"), ("a", "no id"), (None, "no id"), ("b", None), ("c", "")], "item_id string, text string")


def operators(labels, bench):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "packing": lambda d: packing.packed(d, path),
        "quality": lambda d: quality.scored(d, labels),
        "suffixes": suffix_dedup.repeated_spans,
        "templates": line_templates.without_templates,
        "decontamination": lambda d: decontaminate.overlaps(d, bench),
        "near": minhash.near_duplicates,
        "lm": lambda d: lm_score.lm_scores(d, F.lit(True)),
    }


@pytest.mark.parametrize("name", ["packing", "quality", "suffixes", "templates", "decontamination", "near", "lm"])
def test_rows_stay(docs, labels, bench, name):
    run = operators(labels, bench)[name]
    out = run(docs)
    got = out.filter("start = 0").count() if name == "packing" else out.count()
    assert got == len(ROWS)
    if name in ("quality", "templates"):
        assert out.columns[:-1] == docs.columns and out.select(*NAMES).distinct().collect() == [tuple(NAMES)]
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(4))
def test_stages(spark, docs, labels, bench, tmp_path, n):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[n][1]
    out = stage(spark, docs, str(tmp_path))
    # the first stage rejects short and repeating texts, the second none here, the third copies, the fourth what the benchmark holds
    assert out.columns == docs.columns and out.count() == [0, 12, 11, 10][n]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_packing_of_blanks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [c * 1_000_000 for c in (" ", "\n")] + ["a" * 200_000, " \n" * 400_000 + "end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tk = Tokenizer.from_file(path)
    want = {i: tk.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    got = {r.i: r.ids for r in packing.tokenized(frame, path).collect()}
    assert {i: [int.from_bytes(x[j : j + 2], "little") for j in range(0, len(x), 2)] for i, x in got.items()} == want


def test_arguments():
    schema = {"properties": {"q": {"type": "string"}, "to": {"type": "array", "items": {"enum": ["a", "b"]}, "maxItems": 2}, "at": {"properties": {"x": {"type": ["number", "null"]}}, "required": ["x"]}}, "required": ["q"]}
    say = lambda text: tool_calls.faults(text, schema)
    assert say('{"q":"\\ud800"}') is None and say("[" * 100_000) == "not JSON" == say('{"q":' * 100_000) == say('{"q":NaN}') == say(None) == say("")
    assert say("[]") == "not an object" and say('{"q":1}') == "type of q" and say("{}") == "missing q"
    assert say('{"q":"","to":["a","c"]}') == "choice of to[1]" and say('{"q":"","to":["a","b","a"]}') == "length of to"
    assert say('{"at":{"x":null},"q":""}') is None and say('{"at":{},"q":""}') == "missing at.x" and say('{"at":{"x":1,"y":1},"q":""}') == "unexpected at.y"


def test_calls_that_break_writers(spark):
    odd = ['{"query":"\\ud800"}', "[" * 100_000, '{"query":1e999}', '{"query":' + "9" * 5000 + "}", None, ""]
    calls = spark.createDataFrame([(1, f"c{n}", n, "lookup", a, None) for n, a in enumerate(odd)], "conv long, call string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv long, call string, turn long, content string")
    rows = {r.call: r for r in tool_calls.linked(calls, results, tool_calls.SCHEMAS).collect()}
    assert len(rows) == len(odd)
    for n, given in enumerate(odd):
        assert json.loads(rows[f"c{n}"].record)["arguments"] == (json.loads(given) if n == 0 else given)


def test_urls_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "SALT_ROWS", 3)
    ts = lambda d: f"timestamp'2024-01-{d:02d}'"
    entries = spark.sql(f"select * from values ('a.org', {ts(2)}, true), ('a.org', {ts(4)}, false), ('a.org', {ts(6)}, true), ('b.org', timestamp'2000-01-01', true) t(key, at, listed)")
    caps = spark.sql(f"select id as Hit_Url, concat('http://x', id, '.a.org/') as url, timestamp'2024-01-01' + make_dt_interval(id) as at, 'x' as Blocked from range(10)")
    caps = caps.unionByName(spark.sql("select 99L as Hit_Url, 'http://b.org/' as url, timestamp'9999-01-01' as at, 'x' as Blocked"))
    out = url_lists.filtered(caps, entries)
    assert out.columns == [*caps.columns, "_blocked", "n_lists", "matched"]
    assert {r.Hit_Url: r._blocked for r in out.collect()} == {n: n in (1, 2) or n >= 5 for n in range(10)} | {99: True}


def test_warc_ties(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (2, "v", "same"), (None, "u", "same"), (None, "u", "same"), (3, None, "x"), (3, "", "x"), (4, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"Digest": F.lit(1), "first": F.lit(2)})
    warc.write_archives(pages, str(tmp_path / "a"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    assert got == sorted([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (2, "revisit", 2), (0, "response", None), (0, "response", None), (3, "response", None), (3, "revisit", 3), (4, "response", None)])
    assert warc.read_archives(spark, str(tmp_path / "a"), damaged=True).count() == 0


def test_warc_numbers_and_lengths(spark, tmp_path, monkeypatch):
    """Ids over the whole range of a long; payloads that look like headers, with lengths that lead nowhere; files cut by bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    start = "WARC/1.1\r\nContent-Length: "
    hostile = [
        start + "9" * 5000, start + "9" * 5000 + "\r\n\r\n", start + "-5\r\n\r\n\r\n\r\n", start + "\u0664\r\n\r\nabcd\r\n\r\n", start + "9223372036854775807\r\n\r\nx\r\n\r\n", start + "4\r\n\r\nabcd\r\n\r\n",
        "a: WARC/1.1\r\n" * 20_000 + "\r\n", "\r\n".join(["WARC/1.1"] * 20_000) + "\r\n\r\n", "\r\n" * 50_000, "WARC/1.1\r\n\r\n", "x" * 1_000_000,
    ]
    ids = [1234567890123456789, 2**63 - 1, -(2**63), 0, *range(10, 10 + len(hostile))]
    texts = ["same", "same", "same", "own", *hostile]
    pages = spark.createDataFrame(list(zip(ids, ["u"] * len(ids), texts, strict=True)), "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_archives(pages.coalesce(1), folder)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder).collect()}
    want = {i: ("response", None, len(t.encode())) for i, t in zip(ids, texts, strict=True)}
    assert got == want | {i: ("revisit", 2**63 - 1, 4) for i in (1234567890123456789, -(2**63))}
    assert warc.read_archives(spark, folder, damaged=True).count() == 0
    sizes = [r.length for r in spark.read.format("binaryFile").load(folder).select("length").collect()]
    assert len(sizes) == 4 and sum(sizes) > 1_500_000 and sorted(sizes)[-2] < 900_000


def test_odd_names_in_arguments(spark):
    odd = {'{"query":"a","\\ud800":1}': "unexpected \\ud800", '{"query":1e999}': "not JSON", '{"query":"a","\\udfff\\ud800":{}}': "unexpected \\udfff\\ud800", '{"query":-1e400}': "not JSON", '{"query":"1e999"}': None}
    calls = spark.createDataFrame([(1, f"c{n}", n, "lookup", a, None) for n, a in enumerate(odd)], "conv long, call string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv long, call string, turn long, content string")
    rows = tool_calls.linked(calls, results, tool_calls.SCHEMAS).orderBy("turn").collect()
    assert [r.fault for r in rows] == list(odd.values())


def test_largest_id_is_an_id(spark):
    """The greatest long and a missing id are told apart, and each comes back."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(2**63 - 1, text), (None, text), (None, "else " * 30), (2**63 - 1, "other " * 30)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("b", text)], "item_id string, text string")
    ids = lambda df, c="doc_id": sorted((r[c] is None, r[c] or 0) for r in df.collect())
    want = [(False, 2**63 - 1)] * 2 + [(True, 0)] * 2
    assert ids(suffix_dedup.repeated_spans(docs).select(common.id_out().alias("doc_id"))) == want
    assert ids(decontaminate.overlaps(docs, bench).filter(decontaminate.is_contaminated()).select(common.id_out().alias("doc_id"))) == [want[0], want[2]]
    near = minhash.near_duplicates(docs).select(common.id_out().alias("doc_id"), common.id_out("component", "lost").alias("c"), "n")
    assert ids(near) == want and {(r.doc_id, r.c) for r in near.filter("n = 12").collect()} == {(2**63 - 1, 2**63 - 1), (None, 2**63 - 1)}
    assert ids(minhash.keep_one(docs)) == [(False, 2**63 - 1)] * 2 + [(True, 0)]
    assert ids(lm_score.lm_scores(docs, F.lit(True)).select("i"), "i") == want
