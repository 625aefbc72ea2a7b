"""Byte streams from segments: ownership of positions, conflicts, islands, provenance. Segments are (flow, dir, seq, frame, hex).

Nothing is opened into bytes. In the order of (sequence, frame) a segment owns what lies beyond all that earlier ones reach:
one interval, found with a running maximum. So rows grow with segments, and a stream is one sorted pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STREAM = ("flow", "dir")


def with_size(segments: DataFrame) -> DataFrame:
    return segments.withColumn("size", (F.length("hex") / 2).cast("long"))


def tidy_streams(segments: DataFrame) -> DataFrame:
    """(flow, dir, tidy): whether a stream's bytes stand once each, without overlap or hole: its extent is the sum of its sizes and no two segments start together.

    Two segments that overlap and a hole of the same size could make the sums equal, so starts are checked one by one too.
    """
    order = Window.partitionBy(*STREAM).orderBy("seq", "frame")
    steps = with_size(segments).where("size > 0").withColumn("follows", F.coalesce(F.col("seq") == F.lag(F.col("seq") + F.col("size")).over(order), F.lit(True)))
    return steps.groupBy(*STREAM).agg(F.every("follows").alias("tidy"))


def placed(segments: DataFrame) -> DataFrame:
    """Segments that have bytes, with `upto` (how far earlier ones reach, null for the first) and `island` (their contiguous run, from 1)."""
    order = Window.partitionBy(*STREAM).orderBy("seq", "frame")
    rows = with_size(segments).where("size > 0")
    rows = rows.withColumn("upto", F.max(F.col("seq") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("upto").isNull() | (F.col("seq") > F.col("upto")), 1).otherwise(0)
    return rows.withColumn("island", F.sum(opens).over(order))


def owners(segments: DataFrame) -> DataFrame:
    """(flow, dir, island, start, size, frame, off, hex): the interval that each segment owns; at a position the smallest (sequence, frame) counts."""
    rows = placed(segments).withColumn("start", F.greatest("seq", "upto")).withColumn("off", F.col("start") - F.col("seq"))
    own = rows.where("off < size")
    more = [c for c in ("payload_off",) if c in own.columns]
    return own.select(*STREAM, "island", "start", (F.col("size") - F.col("off")).alias("size"), "frame", "off", F.expr("substring(hex, int(2 * off) + 1)").alias("hex"), *more)


def chunks(segments: DataFrame) -> DataFrame:
    """(flow, dir, island, start, size, bytes): contiguous runs of owned positions, from 1, as hexadecimal text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "hex"))), lambda x: x["hex"]), "")
    return owners(segments).groupBy(*STREAM, "island").agg(F.min("start").alias("start"), F.sum("size").alias("size"), text.alias("bytes"))


def conflicts(segments: DataFrame) -> DataFrame:
    """(flow, dir, pos, frame, byte, owner): bytes that differ from their position's owner.

    What a segment shares with earlier ones lies in one island; only streams with such segments are put together, and only
    shares that differ are looked at byte by byte.
    """
    shares = placed(segments).where("upto > seq").withColumn("shared", F.least("size", F.col("upto") - F.col("seq")))
    shares = shares.select(*STREAM, "island", "seq", "frame", F.expr("substring(hex, 1, int(2 * shared))").alias("mine"))
    whole = chunks(segments).select(*STREAM, "island", "start", "bytes")
    met = shares.join(whole, [*STREAM, "island"]).withColumn("theirs", F.expr("substring(bytes, int(2 * (seq - start)) + 1, length(mine))"))
    byte = lambda c, i: F.substring(c, 2 * i + 1, F.lit(2))
    places = F.sequence(F.lit(0), (F.length("mine") / 2).cast("int") - 1)
    odd = met.where("mine <> theirs").select(*STREAM, "seq", "frame", "mine", "theirs", F.explode(F.filter(places, lambda i: byte("mine", i) != byte("theirs", i))).alias("i"))
    return odd.select(*STREAM, (F.col("seq") + F.col("i")).alias("pos"), "frame", byte("mine", F.col("i")).alias("byte"), byte("theirs", F.col("i")).alias("owner"))


def provenance(segments: DataFrame) -> DataFrame:
    """(flow, dir, start, size, frame, off): runs of positions that one frame owns at steady offsets."""
    return owners(segments).select(*STREAM, "start", "size", "frame", "off")


def cited(ranges: DataFrame, slices: DataFrame) -> DataFrame:
    """ranges (flow, dir, id, from, to) clipped to provenance slices: (id, start, size, frame, off), only of ranges that are covered whole."""
    s = slices.select(*(F.col(c).alias(f"s_{c}") for c in slices.columns))
    met = (F.col("flow") == F.col("s_flow")) & (F.col("dir") == F.col("s_dir")) & (F.col("from") < F.col("s_start") + F.col("s_size")) & (F.col("to") > F.col("s_start"))
    start, end = F.greatest("from", "s_start"), F.least("to", F.col("s_start") + F.col("s_size"))
    clipped = ranges.join(s, met).select("id", "from", "to", start.alias("start"), (end - start).alias("size"), F.col("s_frame").alias("frame"), (F.col("s_off") + start - F.col("s_start")).alias("off"))
    whole = clipped.groupBy("id").agg(F.sum("size").alias("got"), F.max(F.col("to") - F.col("from")).alias("need")).where("got = need").select("id")
    return clipped.join(whole, "id", "left_semi").select("id", "start", "size", "frame", "off")


def overlaps(segments: DataFrame, stretch: int = 65_536) -> DataFrame:
    """(flow, dir, frame1, frame2, size): pairs of segments of a stream that share positions, and how many.

    Segments meet by stretches of the stream: the first is in each that it reaches into, the second where it starts. So a
    pair meets once, and a long stream is many short groups.
    """
    a, b = (with_size(segments).where("size > 0").select(*(F.col(c).alias(f"{c}{k}") for c in (*STREAM, "seq", "frame", "size"))) for k in (1, 2))
    part = lambda at: F.floor(at / stretch)
    a = a.withColumn("part1", F.explode(F.sequence(part(F.col("seq1")), part(F.col("seq1") + F.col("size1") - 1))))
    b = b.withColumn("part2", part(F.col("seq2")))
    same = (F.col("flow1") == F.col("flow2")) & (F.col("dir1") == F.col("dir2")) & (F.col("part1") == F.col("part2"))
    met = a.join(b, same & (F.struct("seq1", "frame1") < F.struct("seq2", "frame2")) & (F.col("seq2") < F.col("seq1") + F.col("size1")))
    size = F.least(F.col("seq1") + F.col("size1"), F.col("seq2") + F.col("size2")) - F.col("seq2")
    return met.select(F.col("flow1").alias("flow"), F.col("dir1").alias("dir"), "frame1", "frame2", size.alias("size"))


def within_budget(segments: DataFrame, max_bytes: int, max_segments: int) -> DataFrame:
    """Segments of each flow up to the first, in frame order, that breaks a budget; that one and all later ones go."""
    order = Window.partitionBy("flow").orderBy("frame")
    before = Window.partitionBy("flow").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_size(segments).withColumns({"used": F.sum("size").over(order), "nth": F.row_number().over(order)})
    broken = rows.withColumn("over", (F.col("used") > max_bytes) | (F.col("nth") > max_segments))
    return broken.withColumn("late", F.coalesce(F.max(F.col("over").cast("int")).over(before), F.lit(0)) + F.col("over").cast("int")).where("late = 0").drop("used", "nth", "over", "late")


def openings(segments: DataFrame, most: int = 4) -> DataFrame:
    """(flow, dir, frame, head): what each stream was seen to begin with, up to `most` contiguous bytes (hexadecimal text).

    Segments have head (their first bytes) or hex. As frames come a stream's smallest sequence number can fall; each value
    that it had is one row, with the bytes that had come by the last frame before it fell again. At a position the first
    frame counts. Only the first `most` bytes of a segment are looked at. One window by stream, then equal keys.
    """
    head = F.col("head") if "head" in segments.columns else F.substring("hex", 1, 2 * most)
    rows = segments.select(*STREAM, "seq", "frame", head.alias("head")).where("head <> ''")
    so_far = Window.partitionBy(*STREAM).orderBy("frame", "seq").rowsBetween(Window.unboundedPreceding, 0)
    begun = rows.withColumn("least", F.min("seq").over(so_far)).groupBy(*STREAM, "least").agg(F.max("frame").alias("until"))
    wanted = begun.select(F.col("flow").alias("flow_"), F.col("dir").alias("dir_"), "least", "until", F.explode(F.sequence(F.col("least"), F.col("least") + most - 1)).alias("near"))
    met = rows.join(wanted, (F.col("flow") == F.col("flow_")) & (F.col("dir") == F.col("dir_")) & (F.col("seq") == F.col("near")) & (F.col("frame") <= F.col("until")))
    places = F.sequence(F.lit(0), (F.length("head") / 2).cast("int") - 1)
    each = met.select(*STREAM, "least", "until", "seq", "frame", "head", F.explode(places).alias("i")).withColumn("pos", F.col("seq") + F.col("i")).where(F.col("pos") < F.col("least") + most)
    first = each.groupBy(*STREAM, "least", "until", "pos").agg(F.min_by(F.expr("substring(head, 2 * i + 1, 2)"), F.struct("frame", "seq")).alias("byte"))
    whole = first.groupBy(*STREAM, "least", "until").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos") - F.col("least"), "byte"))).alias("bytes"))
    known = [F.try_element_at("bytes", F.lit(i).cast("long")) for i in range(most)]
    text = F.coalesce(*(F.concat(*known[: n + 1]) for n in reversed(range(most))))
    return whole.select(*STREAM, F.col("until").alias("frame"), text.alias("head"))


def candidates(segments: DataFrame, prefixes: list[str]) -> DataFrame:
    """(flow): flows one of whose streams was at any time seen to begin with one of the prefixes (hexadecimal text, four bytes at most), also across segments."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("head").startswith(p)
    return openings(segments).where(hit).select("flow").distinct()
