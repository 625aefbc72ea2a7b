"""Large captures in ranges: one pass over record headers finds where records begin, then ranges of records are read by many tasks.

Files are opened through pyarrow.fs (local disks, HDFS, S3, GCS), never read whole: the index pass holds a window, a reader
its range. Beyond binaryFile's 2 GB this is the way in; frames are the same as sources.captures.frames() gives.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import captures

RANGE, WINDOW = 64 << 20, 1 << 20
SPANS = "capture string, path string, start long, stop long, first long, head binary"


def opened(uri: str) -> pa.NativeFile:
    """A file by its uri as Spark writes it (characters as they are), or by a local path."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if colon else uri)
    where, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return where.open_input_file(path)


class Window:
    """Bytes of a file at any place, a stretch of WINDOW bytes at a time."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.start, self.held = file, file.size(), 0, b""

    def at(self, place: int, size: int) -> bytes:
        if place < self.start or place + size > self.start + len(self.held):
            self.start, self.held = place, self.file.read_at(max(size, min(WINDOW, max(0, self.size - place))), place) if place < self.size else b""
        return self.held[place - self.start : place - self.start + size]


def steps(window: Window) -> Iterator[tuple[int, int, bytes]]:
    """(place, frames, head) after each record or block: where the next one begins, whether this one was a frame, and the bytes
    that have to stand before it. Ends where a record is cut or broken: what reads that range says what is wrong."""
    magic = window.at(0, 4)
    if magic in captures.PCAP_MAGIC:
        head, order = window.at(0, 24), captures.PCAP_MAGIC[magic][0]
        place = len(head)
        yield place, 0, head
        while len(said := window.at(place, 16)) == 16:
            place += 16 + struct.unpack(order + "4I", said)[2]
            if place > window.size:
                return
            yield place, 1, head
    elif magic == captures.PCAPNG_MAGIC:
        order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(window.at(8, 4))
        place, head = 0, b""
        while order and len(said := window.at(place, 8)) == 8:
            kind, size = struct.unpack(order + "2I", said)
            if size < 12 or place + size > window.size:
                return
            if place == 0 or kind == captures.INTERFACE:
                head += window.at(place, size)
            place += size
            yield place, int(kind in (captures.PACKET, captures.OLD_PACKET)), head


def spans(file: pa.NativeFile, most: int = RANGE) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, first frame, head) of ranges of whole records, about `most` bytes each; the last one goes to the file's end."""
    window = Window(file)
    start, before, first, frame, head = 0, b"", 1, 1, b""
    for place, frames, now in steps(window):
        frame += frames
        if place - start >= most and place < window.size:
            yield start, place, first, before
            start, first, before = place, frame, now
        head = now
    del head
    yield start, window.size, first, before


def digest_of(file: pa.NativeFile) -> str:
    digest, at, size = hashlib.sha256(), 0, file.size()
    while at < size:
        part = file.read_at(min(8 * WINDOW, size - at), at)
        digest.update(part)
        at += len(part)
    return digest.hexdigest()


def read_span(capture: str, path: str, start: int, stop: int, first: int, head: bytes) -> Iterator[tuple]:
    """Rows of FRAMES of a range: its bytes behind the head that the whole file has, through the reader of whole files."""
    with opened(path) as file:
        content = head + file.read_at(stop - start, start)
    frame = first
    try:
        for ts, data, linktype, whole in captures.records(content):
            yield capture, frame, ts, linktype, whole, data, None
            frame += 1
    except (captures.Broken, struct.error) as e:
        yield capture, None, None, None, None, None, str(e) if isinstance(e, captures.Broken) else "capture_record:StructError"


def index(spark: SparkSession, path: str, most: int = RANGE) -> DataFrame:
    """SPANS of the captures below path, a task for each file; each content once, named by its SHA-256."""
    names = [c.split()[0] for c in SPANS.split(", ")]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with opened(uri) as file:
                    capture = digest_of(file)
                    rows = [(capture, uri, *s) for s in spans(file, most)]
                kinds = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    every = found.repartition(F.col("path")).mapInArrow(mapped, SPANS)
    once = every.groupBy("capture").agg(F.min("path").alias("path"))
    return every.join(once, ["capture", "path"]).select(*names)


def frames(indexed: DataFrame) -> DataFrame:
    """FRAMES of ranges, dealt to tasks by capture and place; a task holds one range at a time."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in zip(*(batch.column(c.split()[0]).to_pylist() for c in SPANS.split(", ")), strict=True):
                yield from captures.batched(read_span(*span), FRAME_SCHEMA, 5)

    return indexed.repartition("capture", "start").mapInArrow(mapped, captures.FRAMES)


FRAME_SCHEMA = pa.schema([("capture", pa.string()), ("frame", pa.int64()), ("ts", pa.float64()), ("linktype", pa.int32()), ("orig_len", pa.int64()), ("data", pa.binary()), ("error", pa.string())])


@dataclass
class Span(InputPartition):
    capture: str
    path: str
    start: int
    stop: int
    first: int
    head: bytes


class Reader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def partitions(self) -> list[Span]:
        """The index pass of one capture, as Spark plans the scan."""
        with opened(self.path) as file:
            return [Span(self.path, self.path, *s) for s in spans(file, self.most)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from captures.batched(read_span(partition.capture, partition.path, partition.start, partition.stop, partition.first, partition.head), FRAME_SCHEMA, 5)


class CaptureSource(DataSource):
    """spark.read.format("capture").load(uri): FRAMES of one large capture, named by its uri; option rangeBytes sizes the partitions.

    For folders of many captures index() and frames() do the same with the index pass in tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return captures.FRAMES

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
