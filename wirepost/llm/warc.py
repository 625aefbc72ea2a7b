"""WARC archives: write segmented records with chunked payloads, read them back, reassemble, verify."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, fresh_path, same_keys

#: Digits of base 32 as numbers are written, and as RFC 4648 has them.
NUMERALS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of a record's block before it is continued in further records, and of a chunk of the transfer coding.
SEGMENT, CHUNK = 16_384, 4096
#: Records a file holds at most, so that a reader can take a file whole.
FILE_RECORDS = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hexadecimal digits make eight groups of four base-32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), NUMERALS, RFC4648)


def with_originals(pages: DataFrame, least: int) -> DataFrame:
    """(page, url, payload, digest, refers): refers is the page that holds the same payload and has the smallest id, null for that page itself."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ")
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID))
    rows = pages.select(page.alias("page"), url.alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    # only ids and digests meet by digest; payloads are dealt by page, so a payload that is everywhere stays spread
    light = rows.where((F.octet_length("payload") >= least) & (F.col("page") != NULL_ID)).select("page", "digest", F.xxhash64("digest").alias("h"))
    same = light.groupBy("h", "digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = light.join(same.select(F.col("h").alias("h2"), F.col("digest").alias("digest2"), "first"), same_keys(("h", "h2")) & (F.col("digest") == F.col("digest2")))
    refers = copies.where(F.col("page") != F.col("first")).select(F.col("page").alias("page2"), F.col("digest").alias("digest3"), F.col("first").alias("refers")).distinct()
    met = rows.join(refers, (F.col("page") == F.col("page2")) & (F.col("digest") == F.col("digest3")), "left")
    return met.select("page", "url", "payload", "digest", "refers")


def records(pages: DataFrame, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(record binary): WARC/1.1 records of pages (page_id, url, html), each without the two line ends that close it.

    Every row's record has an id of its own, its number within its task, so rows that repeat in all columns never share one.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            made = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                made += page_records(name_of(page, f"{task}.{row}", digest), url, payload, digest, refers, segment, chunk)
                if len(made) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made = []
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return with_originals(pages, least).mapInArrow(mapped, "record binary")


def name_of(page: int, row: str, digest: str) -> str:
    """A record's id: the page, the row that it was written from, and the digest."""
    return f"<urn:page:{'null' if page == NULL_ID else page}:{row}:{digest}>"


def page_records(own: str, url: str, payload: bytes, digest: str, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{refers}>")]
        yield record("revisit", own, fields, (HTTP + "\r\n").encode())
        return
    block = (HTTP + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload, chunk)
    if len(block) <= segment:
        yield record("response", own, fields, block)
        return
    yield record("response", own, [*fields, ("WARC-Segment-Number", "1")], block[:segment])
    starts = range(segment, len(block), segment)
    for i, at in enumerate(starts, 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at == starts[-1] else []
        yield record("continuation", f"{own[:-1]}:{i}>", [("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), *last], block[at : at + segment])


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        to = data.index(b"\r\n", at)
        size = int(data[at:to].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(data[to + 2 : to + 2 + size])
        if len(out[-1]) != size or data[to + 2 + size : to + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = to + 4 + size


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write pages as gzipped WARC files of at most FILE_RECORDS records below path, with Spark's text writer: a record's closing line ends are its line separator."""
    made = records(pages, **options).select(F.col("record").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-cased name, block) of each record of an archive."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError("no record where one should begin")
        to = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[at:to].decode().split("\r\n")[1:])}
        block = data[to + 4 : to + 4 + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block
        at = to + 8 + len(block)


PARTS = "origin string, segment int, total long, kind string, refers string, digest string, block binary, n long"
DECODED = "page long, record_type string, refers_to long, digest string, n long, payload binary"


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record below path: the record that it continues (or itself), its segment number, the total length if it says so, and its block.

    A record that stands in one piece (segment 0) is decoded at once: its block is the payload, left out if payloads aren't
    wanted, and n the payload's length; a revisit has neither.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse(content.as_py()):
                    number, total, n = int(f.get("warc-segment-number", 0)), f.get("warc-segment-total-length"), None
                    if number == 0:
                        block = None if f["warc-type"] == "revisit" else unframed(f["warc-record-id"], f["warc-payload-digest"], block)
                        n, block = None if block is None else len(block), block if payloads else None
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number, total and int(total), f["warc-type"], f.get("warc-refers-to"), f.get("warc-payload-digest"), block, n))
                if rows:  # a writer that got no page leaves an empty archive
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(mapped, PARTS)


def unframed(origin: str, digest: str, block: bytes) -> bytes:
    """A response's payload out of its transfer framing, held against its digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if re.search(rb"(?i)transfer-encoding:\s*chunked", head) else body
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest.removeprefix("sha1:"):
        raise ValueError(f"the payload of {origin} isn't what its digest says")
    return payload


def reassembled(parts: DataFrame) -> DataFrame:
    """(origin, whole, kind, refers, digest, block, n): records, those in segments joined by segment number.

    A gap in the numbers, a number or a record that comes twice, a missing end or a length other than the one said fails: ids
    are unique, so a group is what one record was cut into. All rows of a record meet in one shuffle, which every use of the
    result can share.
    """
    segment = F.struct("segment", "block", "total", "kind", "refers", "digest", "n")
    each = parts.groupBy("origin").agg(F.array_sort(F.collect_list(segment)).alias("all"))
    first = F.element_at("all", 1)
    each = each.withColumn("whole", (first["segment"] == 0) & (F.size("all") == 1))
    numbers = F.transform("all", lambda s: s["segment"])
    joined = F.unhex(F.array_join(F.transform("all", lambda s: F.hex(s["block"])), ""))  # in one step, however many segments
    each = each.withColumn("block", F.when(F.col("whole"), first["block"]).otherwise(joined))
    total = F.array_max(F.transform("all", lambda s: s["total"]))
    good = F.col("whole") | ((numbers == F.sequence(F.lit(1), F.size("all"))) & total.isNotNull() & (F.octet_length("block") == total))
    fails = F.raise_error(F.concat(F.lit("segments are missing of "), F.col("origin"))).cast("boolean")
    sure = each.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(fails))
    return sure.select("origin", "whole", first["kind"].alias("kind"), first["refers"].alias("refers"), first["digest"].alias("digest"), "block", first["n"].alias("n"))


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """(page, record_type, refers_to, digest, n, payload): the records below path, payloads (null if not wanted) out of their transfer framing, and their lengths; a revisit has neither."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, whole, kind, refers, digest, block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not whole:
                    block = unframed(origin, digest, block)
                    n, block = len(block), block if payloads else None
                rows.append((page_of(origin), kind, page_of(refers) if refers else None, digest.removeprefix("sha1:"), n, block))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in DECODED.split(", ")])

    return reassembled(read_records(spark, path, payloads)).mapInArrow(mapped, DECODED)


def page_of(name: str) -> int:
    page = name.strip("<>").split(":")[2]
    return NULL_ID if page == "null" else int(page)


def archive(pages: DataFrame, least: int = 0, path: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages (page_id, url, html), written to WARC archives and read back.

    The payload is the html in UTF-8; null is empty. Of pages with equal payloads of at least `least` bytes the one with the
    smallest id is a response, the others revisit it; shorter ones are all responses, and so are rows with a null id, which
    stays null. Rows that repeat an id each give a row, responses if they hold the id that others would refer to. Addresses
    lose line ends; null is empty. Other columns are ignored. An empty table gives none. Archives stay below `path`; without
    one, in the shared folder. payload_bytes of a revisit is what its response holds, payload_digest is checked against every
    payload read.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, least=least, **options)
    read = read_archives(spark, path, payloads=False).drop("payload")
    back = read.withColumn("to", F.coalesce("refers_to", "page"))
    wanted = back.where(F.col("refers_to").isNull()).groupBy("page", "digest").agg(F.max("n").alias("whole")).select(F.col("page").alias("page2"), F.col("digest").alias("digest2"), "whole")
    met = back.join(wanted, same_keys(("to", "page2")) & (F.col("digest") == F.col("digest2")), "left")
    sure = F.when(F.col("refers_to").isNull() | F.col("whole").isNotNull(), F.coalesce("n", "whole")).otherwise(F.raise_error(F.lit("a revisit's response is missing")).cast("long"))
    page = F.when(F.col("page") != NULL_ID, F.col("page"))
    return met.select(page.alias("page_id"), sure.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
