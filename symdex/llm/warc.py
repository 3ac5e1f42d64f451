"""Web archives: one gzip member per record, written and read in order.

``write`` turns pages into records: of pages with one payload of ``SHARED_BYTES`` or more, that with the smallest page_id is a response
and the others are revisits that name it; smaller payloads are always responses.  Files are plain ``.warc.gz`` content, of about
``RUN_BYTES`` * ``RUNS`` bytes each.  Spark has no sink for raw bytes, so they go through its text sink: a row holds a run of members without its last byte,
and the line separator is that byte.  A gzip member ends with the size of its data, whose highest byte is 0 below 16 MB; a run that
ends otherwise gets an empty member behind it.

``read`` goes through a file from front to back: it inflates one member after the other in slices of ``SLICE`` bytes, frames header and block by
Content-Length, and verifies both digests.  A damaged record is reported with what is wrong, and reading goes on at the next member.

Defined cases: a null html is an empty payload; a null url has no target header; a row without page_id is always a response and nothing refers
to it; rows that repeat the smallest page_id of a payload are all responses; other columns of the table don't matter; an empty table gives
archives without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import discard, in_batches, stored

#: Payloads of so many bytes are stored once.
SHARED_BYTES = 100
#: Compressed bytes of a run of members, and runs of a file.
RUN_BYTES, RUNS = 8 << 20, 4
#: Compressed bytes that are inflated at once.
SLICE = 1 << 16
#: Bytes of records that leave the reader at once.
OUT_BYTES = 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_EMPTY = zlib.compressobj(wbits=31).flush()

RECORD = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"
_KINDS = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """A record as a gzip member; first: the page whose record a revisit refers to.  A revisit holds the response's header but not its payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first, digest)}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


#: What stays in a header as it is: printable ASCII but "%".
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def _numbers(name: str) -> int | None:
    """The page of a record's name."""
    page = name.removeprefix("<urn:page:").partition(":")[0]
    return int(page) if page else None


def parse(record: bytes) -> dict:
    """Fields of an inflated record; ``problem`` says what is wrong with it."""
    out = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"))
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not mark or not lines[0].startswith("WARC/1.") or not fields.get("content-length", "").isdigit():
        return out | {"problem": "no header"}
    out["record_type"] = fields.get("warc-type")
    if "warc-target-uri" in fields:
        out["url"] = unquote(fields["warc-target-uri"])
    try:
        out["page_id"] = _numbers(fields["warc-record-id"])
        out["refers_to"] = _numbers(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    except (KeyError, ValueError):
        return out | {"problem": "no record id"}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        return out | {"problem": "wrong length"}
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return out | {"problem": "wrong block digest"}
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "revisit":
        return out | {"payload_digest": claimed}
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "problem": None if digest == claimed else "wrong payload digest"}


def records(data: bytes) -> Iterator[dict]:
    """Records of a file in order, with the offset of each one's member."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof and pos < len(data):
                parts.append(z.decompress(view[pos : pos + SLICE]))
                pos += SLICE
        except zlib.error:
            yield {"offset": at, "problem": "damaged member"}
            at = data.find(_MAGIC, at + 1)
            if at < 0:
                return
            continue
        end = min(pos, len(data)) - len(z.unused_data)
        record = b"".join(parts)
        if not z.eof:
            yield {"offset": at, "problem": "cut member"}
        elif record:
            yield {"offset": at} | parse(record)
        at = end


def _hashed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest) with the payload as bytes."""
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): pages whose payload an earlier page has.

    Only ids and digests are shuffled; the first pages of shared payloads are written, so that Spark splits the join at a payload of very many pages.
    """
    sized = _hashed(pages).where("page_id is not null").where(F.octet_length("html") >= SHARED_BYTES).select("page_id", "digest")
    first = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    first = stored(first.select(F.col("digest").alias("d"), "first"), "first-pages")
    return sized.join(first.hint("shuffle_hash"), F.col("digest") == F.col("d")).where("page_id > first").select("page_id", "digest", "first").distinct()


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write the archives of a table of pages (page_id, url, html) to a folder."""
    again = stored(revisits(pages), "revisits")
    named = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").hint("shuffle_hash")
    rows = _hashed(pages).join(named, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            if held[-1][-1]:
                held.append(_EMPTY)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["run"])

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(member(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), first.as_py(), date))
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    members = in_batches(rows).mapInArrow(run, "run binary")
    members.select(F.col("run").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", RUNS).text(path)
    discard(again)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives of a folder, as ``RECORD``; payload: whether to hand their payloads on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, size = [], 0
                for r in records(content.as_py()):
                    r["file"] = name.as_py()
                    size += 200 + (len(r.get("payload") or b"") if payload else 0)
                    if not payload:
                        r["payload"] = None
                    out.append(r)
                    if size >= OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, _KINDS)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, _KINDS)

    return in_batches(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")).mapInArrow(run, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of sound records; the size of a revisit's payload is that of the record it names."""
    sound = found.where("problem is null")
    response = sound.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    target = response.where("page_id is not null").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "payload_bytes").distinct()
    revisit = sound.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    revisit = revisit.join(target.hint("shuffle_hash"), (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return response.unionByName(revisit.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def report(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives to ``path``, read them back, and tell each page's record; a damaged archive is an error."""
    spark = pages.sparkSession
    write(pages, path)
    found = stored(read(spark, path, payload=False).drop("payload"), "records")
    bad = found.where("problem is not null").select("file", "offset", "problem").first()
    if bad:
        raise ValueError(f"{bad['problem']} at {bad['offset']} of {bad['file']}")
    return resolved(found)


def brute_force(pages: list[tuple]) -> list[tuple]:
    """The same rows by plain Python, for tests; pages: (page_id, html)."""
    payload = [(i, (h or "").encode()) for i, h in pages]
    out = []
    for i, p in payload:
        first = min((j for j, o in payload if o == p and j is not None), default=None) if len(p) >= SHARED_BYTES and i is not None else None
        again = first is not None and first != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return out
