"""Captures as they arrive in a folder: the same sources and decoders over a stream of files, counted by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import captures

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (capture, content, arrived): files that are written below path, named by their SHA-256; a file that comes again within an hour counts once."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    named = found.select(F.sha2("content", 256).alias("capture"), "content", F.col("modificationTime").alias("arrived"))
    return named.withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["capture"])


def traffic(arrived: DataFrame, every: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """A stream of (start, server_port, segments, bytes, payloads): TCP segments by the time in the capture and the lower of their ports.

    Segments that are more than `late` behind the latest one seen aren't counted: captures may come in any order within it.
    """
    segments = captures.segments(captures.frames(arrived.select("capture", "content"))).where("skip IS NULL AND frame IS NOT NULL")
    timed = segments.select(F.timestamp_seconds("ts").alias("at"), F.least("sport", "dport").alias("server_port"), F.octet_length("payload").alias("size"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", every), "server_port")
    return counted.agg(F.count("*").alias("segments"), F.sum("size").alias("bytes"), F.count_if(F.col("size") > 0).alias("payloads")).select(F.col("window.start").alias("start"), "server_port", "segments", "bytes", "payloads")
