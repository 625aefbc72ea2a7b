"""The table of flows against a plain list in order of use, and streams against batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_captures import CLIENT, SERVER, ethernet, pcap, tcp

from wirepost.functions.tracking import Budget
from wirepost.operators import flows, tracking
from wirepost.sources import captures
from wirepost.streaming import tracking as live


def brute(rows, budget):
    """Events by a list of flows, oldest first, that is searched from end to end each time."""
    out, order, kept = [], [], {}
    for flow, frame, size in rows:
        if flow in order:
            order.remove(flow)
        else:
            kept[flow] = {"first": frame, "sizes": [], "full": False}
        order.append(flow)

        def give_up(frame=frame):
            gone = order.pop(0)
            out.append((gone, kept.pop(gone)["first"], frame, "evicted"))

        while len(order) > budget.flows:
            give_up()
        me = kept[flow]
        if me["full"] or sum(me["sizes"]) + size > min(budget.each, budget.total) or len(me["sizes"]) >= budget.segments:
            me["full"] = True
            out.append((flow, me["first"], frame, "left"))
            continue
        while sum(sum(k["sizes"]) for k in kept.values()) + size > budget.total:
            give_up()
        me["sizes"].append(size)
        out.append((flow, me["first"], frame, "kept"))
    return out


BUDGETS = [Budget(3), Budget(1), Budget(50, 900), Budget(50, 5000, 120), Budget(50, 5000, 5000, 4), Budget(5, 400, 150, 6), Budget(2, 0, 0)]


def traffic(seed, n=400):
    rng = random.Random(seed)
    return [(str(min(rng.randrange(12), rng.randrange(12))), frame, rng.choice((0, 0, 10, 60, 130))) for frame in range(1, n + 1)]


@pytest.mark.parametrize("budget", BUDGETS)
def test_table_as_brute_force(spark, budget):
    rows = {f"c{i}": traffic(i) for i in range(3)}
    df = spark.createDataFrame([(c, *r) for c, own in rows.items() for r in own], "capture string, flow string, frame long, size long").orderBy(F.rand(1))
    got = {tuple(r) for r in tracking.recency(df, budget).collect()}
    want = {(c, *e) for c, own in rows.items() for e in brute(own, budget)}
    assert got == want
    held = tracking.within_budget(df, budget)
    gone = {e[:3] for e in want if e[4] == "evicted"}
    lost = {e[:2] for e in want if e[4] != "kept"}
    assert {(r.capture, r.flow, r.frame, r.incomplete) for r in held.collect()} == {(c, f, n, (c, f) in lost) for c, f, first, n, e in want if e == "kept" and (c, f, first) not in gone}


def test_budgets_without_room_are_refused():
    for bad in (Budget(0), Budget(1, -1), Budget(1, 1, 1, 0)):
        with pytest.raises(ValueError):
            live.Recency(bad)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, live.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, made, schema, folder, name, out):
    """One micro-batch a file, from where the checkpoint says."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = made(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def noisy_capture(seed):
    """Frames of a few endpoint pairs with SYNs, repeats, resets and data before, between and after."""
    rng = random.Random(seed)
    out, seqs = [], {}
    for _ in range(160):
        client = ("10.0.0.1", 40000 + rng.randrange(4))
        a, b = rng.choice(((client, SERVER), (SERVER, client)))
        kind = rng.choices(("data", "syn", "synack", "rst", "again"), (8, 1, 1, 1, 1))[0]
        seq = seqs.get((a, b), 100)
        if kind in ("syn", "again"):
            seq = rng.choice((100, 5000)) if kind == "syn" else seq
            out.append(tcp(a, b, seq, b"", 2))
            seqs[a, b] = seq + 1
        elif kind == "synack":
            out.append(tcp(a, b, seq, b"", 18))
            seqs[a, b] = seq + 1
        elif kind == "rst":
            out.append(tcp(a, b, seq, b"", 4))
        else:
            data = b"x" * rng.randrange(0, 5)
            seq += rng.choice((0, 0, 0, 7))
            out.append(tcp(a, b, seq, data))
            seqs[a, b] = seq + len(data)
    return pcap([ethernet(x) for x in out])


def test_generations_of_a_stream_as_of_a_batch(rocks, tmp_path):
    spark = rocks
    made = spark.createDataFrame([(f"c{i}", noisy_capture(i)) for i in range(4)], "capture string, content binary")
    segments = captures.segments(captures.frames(made))
    want = {(r.capture, r.port1, r.port2, r.frame, r.generation) for r in flows.generations(segments).collect()}
    assert max(w[4] for w in want) >= 3
    last = captures.segments(captures.frames(spark.createDataFrame([("end", pcap([ethernet(tcp(CLIENT, SERVER, 1, b""))]))], "capture string, content binary"))).withColumn("ts", F.lit(1e6))
    shuffled = segments.withColumn("part", (F.rand(3) * 5).cast("int"))
    shuffled.where("part < 3").drop("part").write.partitionBy().parquet(f"{tmp_path}/in/a")
    out = str(tmp_path / "out")
    run(spark, live.generations, segments.schema, tmp_path, "check", out)
    shuffled.where("part >= 3").drop("part").write.parquet(f"{tmp_path}/in/b")  # the second run goes on from the state of the first
    run(spark, live.generations, segments.schema, tmp_path, "check", out)
    for name, ts in (("y", 1e6), ("z", 2e6)):
        last.withColumn("ts", F.lit(ts)).write.parquet(f"{tmp_path}/in/{name}")
        run(spark, live.generations, segments.schema, tmp_path, "check", out)
    got = [(r.capture, r.port1, r.port2, r.frame, r.generation) for r in spark.read.parquet(out).collect() if r.capture != "end"]
    assert len(got) == len(want) and set(got) == want


def test_table_of_a_stream_as_of_a_batch(rocks, tmp_path):
    spark, budget = rocks, Budget(5, 400, 150, 6)
    rows = [(f"c{i}", *r, float(r[1])) for i in range(2) for r in traffic(20 + i, 150)]
    df = spark.createDataFrame(rows, "capture string, flow string, frame long, size long, ts double")
    want = {tuple(r) for r in tracking.recency(df, budget).collect()}
    halves = df.withColumn("part", (F.col("frame") > 70).cast("int"))
    out = str(tmp_path / "out")
    table = lambda s: live.recency(s, budget, "1 second")
    for part in (0, 1):
        halves.where(f"part = {part}").drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
        run(spark, table, df.schema, tmp_path, "check", out)
    for name, ts in (("y", 1e6), ("z", 2e6)):
        spark.createDataFrame([("end", "f", 1, 0, ts)], df.schema).write.parquet(f"{tmp_path}/in/{name}")
        run(spark, table, df.schema, tmp_path, "check", out)
    got = [tuple(r) for r in spark.read.parquet(out).collect() if r.capture != "end"]
    assert len(got) == len(want) and set(got) == want
