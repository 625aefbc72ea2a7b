"""Queries of the reassembly operators over conversations, and of counters and as-of matches over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.tracking import Budget
from ..operators import asof, reassembly, tracking
from .bridge import SEGMENTS_SQL, SENT_SQL, segments, table

#: Openings, in hexadecimal, that make a flow a candidate here.
PREFIXES = ["5468", "4F6E", "4572"]


def agg_05(s, d):
    rows = reassembly.with_size(segments(s, d))
    return rows.groupBy("flow").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("size").alias("bytes"), F.count("*").alias("segments"), (F.min_by("seq", "frame") > 0).alias("midstream"))


def agg_08(s, d):
    return reassembly.chunks(segments(s, d)).groupBy("flow", "dir").agg((F.count("*") - 1).alias("holes"), (F.count("*") > 1).alias("incomplete"))


def agg_09(s, d):
    return reassembly.chunks(segments(s, d)).select("flow", "dir", "island", "start", "size", F.sha2("bytes", 256).alias("sha"))


def win_04(s, d):
    return agg_09(s, d).where("island = 1").drop("island")


def jon_03(s, d):
    slices = reassembly.provenance(segments(s, d))
    ranges = segments(s, d).groupBy("flow", "dir").agg(F.min("seq").alias("base"))
    ranges = ranges.select("flow", "dir", F.concat_ws(":", F.col("flow").cast("string"), "dir").alias("id"), (F.col("base") + 5).alias("from"), (F.col("base") + 405).alias("to"))
    return reassembly.cited(ranges, slices)


def srt_01(s, d):
    return segments(s, d).groupBy("flow", "dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]).alias("frames"))


def srt_12(s, d):
    return reassembly.within_budget(segments(s, d), 600, 6).select("flow", "frame")


def events(s, d):
    return table(s, d, "events")


#: Flows that the table of win_15 holds.
HELD = 40


def win_15(s, d):
    """events as packets: users are flows, types captures; each stay of a flow in a table of HELD flows that gives up the one touched longest ago."""
    rows = events(s, d).select(F.col("event_type").alias("capture"), F.col("user_id").alias("flow"), F.col("event_id").alias("frame"), F.octet_length(F.coalesce("props", F.lit(""))).alias("size"))
    return tracking.stays(tracking.recency(rows, Budget(flows=HELD)))


def agg_02(s, d):
    kinds = s.createDataFrame([(k,) for k in ("signup", "error", "view", "nosuch")], "event_type string")
    counted = events(s, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(counted, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def agg_03(s, d):
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    return events(s, d).agg(is_("click").alias("clicks"), is_("error").alias("errors"), F.bool_or(F.col("value") < 0).alias("any_negative"), F.sum(F.floor("value").cast("long")).alias("bytes"))


def win_10(s, d):
    first = events(s, d).groupBy("user_id").agg(F.min("ts").alias("first"))
    ms = F.bround((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1000, 0)
    return events(s, d).join(first, "user_id").select("event_id", ms.cast("long").alias("t_ms"))


def _next(s, d, kind, wanted):
    rows = events(s, d).select("event_id", "user_id", "ts", "event_type")
    found = asof.next_match(rows, "user_id", "ts", F.col("event_type").isin(*wanted), "event_id", F.date_trunc("day", F.col("ts")))
    return found.where(F.col("event_type") == kind).select("event_id", F.col("next_value").alias("next_id"))


def _dense(first):
    """Ranks by (counts of buckets before) + (rank in bucket), bucket counts summed up likewise: no window over the whole table."""
    rows = first.withColumn("b", F.floor(F.col("first_event") / 1000))
    counts = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("bb", F.floor(F.col("b") / 1000))
    upper = counts.groupBy("bb").agg(F.sum("n").alias("nn"))
    upper = upper.select(F.col("bb").alias("bb2"), (F.sum("nn").over(Window.orderBy("bb")) - F.col("nn")).alias("far"))  # a row for a million places
    near = F.sum("n").over(Window.partitionBy("bb").orderBy("b")) - F.col("n")
    before = counts.withColumn("near", near).join(upper, F.col("bb") == F.col("bb2")).select(F.col("b").alias("b2"), (F.col("far") + F.col("near")).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("first_event")))
    return ranked.join(before, F.col("b") == F.col("b2")).select("user_id", (F.col("before") + F.col("r")).alias("stream"))


QUERIES = {
    "agg_01": lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("n")),
    "agg_02": agg_02,
    "agg_03": agg_03,
    "agg_04": lambda s, d: events(s, d).agg(F.count_distinct("user_id").alias("flows")),
    "agg_05": agg_05,
    "agg_06": lambda s, d: reassembly.owners(segments(s, d)).groupBy("flow", "dir", "frame").agg(F.sum("size").alias("owned")),
    "agg_07": lambda s, d: reassembly.conflicts(segments(s, d)),
    "agg_08": agg_08,
    "agg_09": agg_09,
    "agg_10": lambda s, d: segments(s, d).groupBy("flow").agg((F.min("seq") > 0).alias("midstream")),
    "agg_13": lambda s, d: events(s, d).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("packets")),
    "agg_36": lambda s, d: segments(s, d).groupBy("flow").agg(F.min("frame").alias("first_frame")).orderBy("first_frame"),
    "flt_01": lambda s, d: events(s, d).agg(F.count_if(F.col("user_id").isin(25, 110, 143)).alias("kept"), F.count_if(~F.col("user_id").isin(25, 110, 143)).alias("skipped")),
    "flt_02": lambda s, d: reassembly.candidates(segments(s, d), PREFIXES),
    "flt_03": lambda s, d: segments(s, d).join(reassembly.candidates(segments(s, d), PREFIXES), "flow", "left_semi").select("flow", "dir", "frame"),
    "jon_02": lambda s, d: reassembly.overlaps(segments(s, d)),
    "jon_03": jon_03,
    "jon_05": lambda s, d: _next(s, d, "click", ["purchase"]),
    "jon_07": lambda s, d: _next(s, d, "signup", ["view"]),
    "jon_08": lambda s, d: _next(s, d, "error", ["click", "purchase", "view"]),
    "jon_19": lambda s, d: events(s, d).groupBy("user_id").agg(F.min_by("ts", "event_id").alias("captured")),
    "srt_01": srt_01,
    "srt_12": srt_12,
    "win_01": lambda s, d: _dense(events(s, d).select(F.col("event_id").alias("user_id"), F.col("event_id").alias("first_event"))).select(F.col("user_id").alias("event_id"), F.col("stream").alias("nth")),
    "win_02": lambda s, d: reassembly.chunks(segments(s, d)).select("flow", "dir", "island", "start", "size"),
    "win_03": lambda s, d: reassembly.provenance(segments(s, d)),
    "win_04": win_04,
    "win_06": lambda s, d: _dense(events(s, d).groupBy("user_id").agg(F.min("event_id").alias("first_event"))),
    "win_10": win_10,
    "win_15": win_15,
    "reassembly_tidy": lambda s, d: reassembly.tidy_streams(segments(s, d)),
}
SEG = f"WITH {SENT_SQL}, g AS ({SEGMENTS_SQL}), z AS (SELECT *, length(hex) // 2 AS size FROM g WHERE hex <> '')"
POS = f"""{SEG}, p AS (SELECT flow, dir, seq, frame, off, seq + off AS pos, substr(hex, 2 * off + 1, 2) AS byte FROM (SELECT *, unnest(range(size)) AS off FROM z)),
    w AS (SELECT DISTINCT ON (flow, dir, pos) flow, dir, pos, frame, off, byte FROM p ORDER BY flow, dir, pos, seq, frame)"""
ISL = f"""{POS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY flow, dir ORDER BY pos) AS grp FROM w),
    c AS (SELECT flow, dir, min(pos) AS start, count(*) AS size, string_agg(byte, '' ORDER BY pos) AS bytes FROM i GROUP BY flow, dir, grp),
    k AS (SELECT *, row_number() OVER (PARTITION BY flow, dir ORDER BY start) AS island FROM c)"""
PROV = f"""{POS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY flow, dir, frame ORDER BY pos) AS grp FROM w),
    v AS (SELECT flow, dir, min(pos) AS start, count(*) AS size, frame, min(off) AS off FROM i GROUP BY flow, dir, frame, grp)"""


def _next_sql(kind: str, wanted: str) -> str:
    return f"""SELECT event_id, (SELECT arg_min(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.event_type IN ({wanted})) AS next_id
        FROM events a WHERE event_type = '{kind}'"""


#: What a stream was seen to begin with, at any time: for each smallest sequence number so far, its first two bytes as they had come by then.
CAND = f"""{SEG}, r AS (SELECT *, min(seq) OVER (PARTITION BY flow, dir ORDER BY frame, seq ROWS UNBOUNDED PRECEDING) AS least FROM z),
    e AS (SELECT flow, dir, least, max(frame) AS until FROM r GROUP BY ALL),
    b AS (SELECT e.flow, e.dir, least, z.seq + i - least AS nth, arg_min(substr(hex, CAST(2 * i + 1 AS INTEGER), 2), frame) AS byte
          FROM e JOIN (SELECT *, unnest(range(least(size, 4))) AS i FROM z) z ON e.flow = z.flow AND e.dir = z.dir AND z.frame <= until AND z.seq BETWEEN least AND least + 3
          WHERE z.seq + i < least + 4 GROUP BY ALL),
    h AS (SELECT DISTINCT x.flow FROM b x JOIN b y ON x.flow = y.flow AND x.dir = y.dir AND x.least = y.least AND x.nth = 0 AND y.nth = 1 WHERE x.byte || y.byte IN ('5468', '4F6E', '4572'))"""
ORACLES = {
    "agg_01": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "agg_02": "SELECT k AS event_type, count(event_id) AS n FROM (VALUES ('signup'), ('error'), ('view'), ('nosuch')) v(k) LEFT JOIN events ON event_type = k GROUP BY k",
    "agg_03": "SELECT count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, bool_or(value < 0) AS any_negative, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events",
    "agg_04": "SELECT count(DISTINCT user_id) AS flows FROM events",
    "agg_05": f"{SEG} SELECT flow, min(frame) AS first_frame, max(frame) AS last_frame, CAST(sum(length(hex) // 2) AS BIGINT) AS bytes, count(*) AS segments, arg_min(seq, frame) > 0 AS midstream FROM g GROUP BY flow",
    "agg_06": f"{POS} SELECT flow, dir, frame, count(*) AS owned FROM w GROUP BY ALL",
    "agg_07": f"{POS} SELECT p.flow, p.dir, p.pos, p.frame, p.byte, w.byte AS owner FROM p JOIN w USING (flow, dir, pos) WHERE p.byte <> w.byte",
    "agg_08": f"{ISL} SELECT flow, dir, count(*) - 1 AS holes, count(*) > 1 AS incomplete FROM k GROUP BY ALL",
    "agg_09": f"{ISL} SELECT flow, dir, island, start, size, sha256(bytes) AS sha FROM k",
    "agg_10": f"{SEG} SELECT flow, min(seq) > 0 AS midstream FROM g GROUP BY flow",
    "agg_13": "SELECT min(ts) AS first, max(ts) AS last, count(*) AS packets FROM events",
    "agg_36": f"{SEG} SELECT flow, min(frame) AS first_frame FROM g GROUP BY flow",
    "flt_01": "SELECT count(*) FILTER (WHERE user_id IN (25, 110, 143)) AS kept, count(*) FILTER (WHERE user_id NOT IN (25, 110, 143)) AS skipped FROM events",
    "flt_02": f"{CAND} SELECT flow FROM h",
    "flt_03": f"{CAND} SELECT flow, dir, frame FROM g WHERE flow IN (SELECT flow FROM h)",
    "jon_02": f"""{SEG} SELECT a.flow, a.dir, a.frame AS frame1, b.frame AS frame2, least(a.seq + a.size, b.seq + b.size) - b.seq AS size
        FROM z a JOIN z b ON a.flow = b.flow AND a.dir = b.dir AND (a.seq < b.seq OR (a.seq = b.seq AND a.frame < b.frame)) AND b.seq < a.seq + a.size""",
    "jon_03": f"""{PROV}, r AS (SELECT flow, dir, min(seq) + 5 AS lo, min(seq) + 405 AS hi FROM g GROUP BY ALL),
        c AS (SELECT r.flow || ':' || r.dir AS id, greatest(lo, start) AS start, least(hi, start + size) - greatest(lo, start) AS size, frame, off + greatest(lo, start) - start AS off
              FROM r JOIN v ON r.flow = v.flow AND r.dir = v.dir AND lo < start + size AND hi > start)
        SELECT * FROM c WHERE id IN (SELECT id FROM c GROUP BY id HAVING sum(size) = 400)""",
    "jon_05": _next_sql("click", "'purchase'"),
    "jon_07": _next_sql("signup", "'view'"),
    "jon_08": _next_sql("error", "'click', 'purchase', 'view'"),
    "jon_19": "SELECT user_id, arg_min(ts, event_id) AS captured FROM events GROUP BY user_id",
    "srt_01": f"{SEG} SELECT flow, dir, list(frame ORDER BY seq, frame) AS frames FROM g GROUP BY ALL",
    "srt_12": f"""{SEG}, b AS (SELECT flow, frame, sum(length(hex) // 2) OVER w > 600 OR row_number() OVER w > 6 AS bad FROM g WINDOW w AS (PARTITION BY flow ORDER BY frame ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT flow, min(frame) AS cut FROM b WHERE bad GROUP BY flow) SELECT b.flow, frame FROM b LEFT JOIN f USING (flow) WHERE cut IS NULL OR frame < cut""",
    "win_01": "SELECT event_id, row_number() OVER (ORDER BY event_id) AS nth FROM events",
    "win_02": f"{ISL} SELECT flow, dir, island, start, size FROM k",
    "win_03": f"{PROV} SELECT * FROM v",
    "win_04": f"{ISL} SELECT flow, dir, start, size, sha256(bytes) AS sha FROM k WHERE island = 1",
    "win_06": "SELECT user_id, row_number() OVER (ORDER BY m) AS stream FROM (SELECT user_id, min(event_id) AS m FROM events GROUP BY user_id)",
    "win_10": "SELECT event_id, CAST(round_even((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1000.0, 0) AS BIGINT) AS t_ms FROM events",
    "win_15": f"""
        WITH e AS (SELECT event_type AS capture, CAST(user_id AS VARCHAR) AS flow, event_id AS frame, lead(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS again FROM events),
        o AS (SELECT a.capture, a.flow, a.frame, b.flow AS other, min(b.frame) AS seen FROM e a JOIN e b ON a.capture = b.capture AND b.frame > a.frame AND (a.again IS NULL OR b.frame < a.again) GROUP BY ALL),
        g AS (SELECT capture, flow, frame, seen AS evicted_at FROM (SELECT *, row_number() OVER (PARTITION BY capture, flow, frame ORDER BY seen) AS n FROM o) WHERE n = {HELD}),
        t AS (SELECT e.*, evicted_at, count(evicted_at) OVER (PARTITION BY e.capture, e.flow ORDER BY e.frame) - CAST(evicted_at IS NOT NULL AS INTEGER) AS stay FROM e LEFT JOIN g ON e.capture = g.capture AND e.flow = g.flow AND e.frame = g.frame)
        SELECT capture, flow, min(frame) AS first, count(*) AS kept, CAST(0 AS BIGINT) AS left, max(evicted_at) AS evicted_at FROM t GROUP BY capture, flow, stay""",
    "reassembly_tidy": f"{SEG}, t AS (SELECT flow, dir, seq = lag(seq + size) OVER (PARTITION BY flow, dir ORDER BY seq, frame) AS f FROM z) SELECT flow, dir, bool_and(coalesce(f, true)) AS tidy FROM t GROUP BY ALL",
}
