"""WARC archives: writing with revisit records, and reading back through verified record boundaries."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, small, staged

MAGIC, CLOSE = b"WARC/1.1\r\n", "\r\n\r\n"
#: A file ends after the record that brings it to this size.
FILE_BYTES = 1 << 20
LONG = 2**63
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def planned(pages: DataFrame, id_col: str, url_col: str, body_col: str, least_bytes: int) -> DataFrame:
    """(i, url, body, digest, first): first is the largest id with the same payload, null for that row itself.

    Payloads that occur once need no partner, so only repeated digests are joined: by broadcast up to small()'s bound (28-byte
    rows, so 6 MB), else by a shuffle.  Of several rows with the largest id and the payload, one with the greatest url is the
    response, and the others revisit it.
    """
    i, body = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{body_col}`"), F.lit(""))
    rows = pages.select(i.alias("i"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("digest"))
    each = rows.groupBy("digest", "i").agg(F.count("*").alias("n"))
    first = each.groupBy("digest").agg(F.max(F.struct("i", "n")).alias("f"), F.sum("n").alias("n")).filter("n > 1")
    first = staged(first.select("digest", F.col("f.i").alias("first"), (F.col("f.i").isNotNull() & (F.col("f.n") > 1)).alias("tied")), "repeated")
    both = rows.join(small(first), "digest", "left").withColumn("tied", F.coalesce("tied", F.lit(False)) & (F.col("i") == F.col("first")))
    alone = (F.octet_length("body") < least_bytes) | F.col("i").isNull() | F.col("first").isNull()
    plain = both.withColumn("first", F.when(~alone & (F.col("i") != F.col("first")), F.col("first")))
    if not first.filter("tied").limit(1).count():
        return plain.drop("tied")
    same = both.filter("tied").groupBy("i", "url", "body", "digest").agg(F.count("*").alias("n"))
    ties = same.join(same.groupBy("digest").agg(F.max("url").alias("top")), "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    response = (F.octet_length("body") < least_bytes) | ((F.col("url") == F.col("top")) & (F.col("copy") == 1))
    return plain.filter(~F.col("tied") | F.col("tied").isNull()).drop("tied").unionByName(ties.select("i", "url", "body", "digest", F.when(~response, F.col("i")).alias("first")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> None:
    """Write a record for each row into files under folder that end with the record that brings them to FILE_BYTES.

    Of rows with equal payloads of least_bytes or more, that with the largest id is a response and the others are
    revisits without a payload; rows without an id are responses.  A null payload or url counts as empty.  White space and
    control characters of a url are percent-encoded, so that they can't break the header.
    """

    def run(batches):
        held, size = [], 0
        value = lambda: pa.RecordBatch.from_pydict({"value": pa.array([CLOSE.join(held)], pa.string())})
        for batch in batches:
            for i, url, body, first in zip(*(batch.column(c).to_pylist() for c in ("i", "url", "body", "first")), strict=True):
                payload = body.encode()
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                block = (_HTTP if first is None else b"HTTP/1.1 200 OK\r\n\r\n") + (payload if first is None else b"")
                head = [
                    f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(i)}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}",
                    "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if i is None else i}",
                ]
                if first is not None:
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}", f"X-Refers-To-Page: {first}"]
                head.append(f"Content-Length: {len(block)}")
                held.append(MAGIC.decode() + "\r\n".join(head) + "\r\n\r\n" + block.decode())
                size += len(block)
                if size >= FILE_BYTES:
                    yield value()
                    held, size = [], 0
        if held:
            yield value()

    rows = planned(pages, id_col, url_col, body_col, least_bytes).select("i", "url", "body", "first")
    records = rows.mapInArrow(run, "value string")
    # a value is a file: the text writer ends it with lineSep, which is just what ends a record
    records.write.option("lineSep", CLOSE).option("maxRecordsPerFile", 1).text(folder)


_FIELDS = "file string, at long, next long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each place in a file that looks like a record, whether or not it is inside a payload.

    next: where the record after it would start, by its header.  intact: the payload has the length and digest of
    the header.  Lengths and ids are decimal numbers that fit a long, others count as missing; a record without a length, or with one that leads
    beyond the file, is none.
    """

    def number(text: bytes | None) -> int | None:
        out = int(text) if text and re.fullmatch(rb"-?\d{1,19}", text) else LONG
        return out if -LONG <= out < LONG else None

    def parse(data: bytes):
        """(at, fields of the record) of each place with the magic and a header whose length leads to the end of a record.

        Headers that end at one place share their last lines, so they are read from the last to the first, each line once.
        """
        ends = [m.start() for m in re.finditer(rb"(?=\r\n\r\n)", data)]
        by_end = defaultdict(list)
        for m in re.finditer(re.escape(MAGIC), data):
            stop = bisect.bisect_left(ends, m.end() - 2)
            if stop < len(ends):
                by_end[ends[stop]].append(m.start())
        for stop, places in by_end.items():
            fields, upto, digests = {}, stop, {}
            for at in reversed(places):
                lines = data[at + len(MAGIC) : upto].removesuffix(b"\r\n").split(b"\r\n") if at + len(MAGIC) < upto else []
                if not all(b": " in x for x in lines):
                    break
                for name, value in (x.split(b": ", 1) for x in reversed(lines)):
                    fields.setdefault(name, value)
                upto = at + len(MAGIC)
                length, body = number(fields.get(b"Content-Length")), stop + 4
                if length is None or not 0 <= length <= len(data) - body or data[body + length : body + length + 4] != b"\r\n\r\n":
                    continue
                end, text = body + length, lambda k: fields.get(k, b"").decode("utf-8", "replace")
                kind, digest, size = text(b"WARC-Type"), text(b"WARC-Payload-Digest").removeprefix("sha1:"), number(fields.get(b"X-Payload-Length"))
                split = data.find(b"\r\n\r\n", body, end)
                if kind == "response" and end not in digests:
                    payload = data[split + 4 : end] if split >= 0 else b""
                    digests[end] = _digest(payload), len(payload)
                yield at, end + 4, kind, number(fields.get(b"X-Page-ID")), number(fields.get(b"X-Refers-To-Page")), size, digest, kind != "response" or digests[end] == (digest, size)

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content"), strict=True):
                out = [dict(zip(schema.names, (file.as_py(), *found), strict=True)) for found in parse(data.as_py())]
                yield pa.RecordBatch.from_pylist(out, schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, _FIELDS)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain of records from the start of their file reaches, by pointer jumping.

    After round r, `hop` leads 2**r records on and `on` marks the first 2**r records of each chain, so rounds grow
    with the logarithm of the records in a file.
    """
    now = staged(found.select("file", "at", F.col("next").alias("hop"), (F.col("at") == 0).alias("on")), "hops")
    while True:
        reach = now.filter("on").select("file", F.col("hop").alias("at"), F.lit(True).alias("new"))
        jump = now.select("file", F.col("at").alias("hop"), F.col("hop").alias("far"))
        step = now.join(reach, ["file", "at"], "left").join(jump, ["file", "hop"], "left")
        new = staged(step.select("file", "at", F.col("far").alias("hop"), (F.col("on") | F.coalesce("new", F.lit(False))).alias("on"), (~F.col("on") & F.col("new").isNotNull()).alias("grew")), "hops")
        discard(now)
        now = new
        if not now.filter("grew").limit(1).count():
            return now.filter("on").select("file", "at")


def read_archives(spark: SparkSession, folder: str, damaged: bool = False) -> DataFrame:
    """The records of all files under folder: those on the chain from each file's start, whose payload is intact.

    With `damaged`, the others on the chain are returned instead, for a report.  A magic string inside a payload may look like a
    record; no chain from the start leads to it.  An empty folder has no records.  A file must fit into a task, as those of
    write_archives() do: FILE_BYTES and the largest page at most.
    """
    found = staged(candidates(spark, folder), "candidates")
    return found.join(reachable(found), ["file", "at"], "left_semi").filter(F.col("intact") != damaged)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
