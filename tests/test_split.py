"""Captures read in ranges against captures read whole."""

from __future__ import annotations

import random

import pytest
from test_captures import CLIENT, SERVER, ethernet, pcap, pcapng, tcp

from wirepost.sources import captures, split


def packets(n, seed):
    rng = random.Random(seed)
    return [ethernet(tcp(CLIENT, SERVER, i, rng.randbytes(rng.randrange(0, 900)))) for i in range(n)]


def rows(df):
    return sorted((r.capture, r.frame or 10**9, r.ts, r.linktype, r.orig_len, bytes(r.data or b""), r.error) for r in df.collect())


ODD = {"plain": pcap(packets(300, 1)), "big": pcap(packets(200, 2), order=">"), "ng": pcapng(packets(300, 3)), "ng big": pcapng(packets(50, 4), ">"), "cut": pcap(packets(100, 5))[:-7], "tail": pcap(packets(80, 6), tail=b"12345"), "ng cut": pcapng(packets(90, 7))[:-9], "magic": b"?" * 5000, "short": b"\xd4\xc3", "empty": b"", "no frames": pcap([])}


def test_ranges_give_the_same_frames(spark, tmp_path):
    for name, content in ODD.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "copy").write_bytes(ODD["plain"])
    indexed = split.index(spark, str(tmp_path), 8192)
    whole = captures.files(spark, str(tmp_path))
    assert indexed.groupBy("capture").count().agg({"count": "max"}).first()[0] >= 16
    assert rows(split.frames(indexed)) == rows(captures.frames(whole))
    assert rows(split.frames(split.index(spark, str(tmp_path), 1))) == rows(captures.frames(whole))  # a range for each record


@pytest.mark.parametrize("name", ["plain", "ng", "cut"])
def test_source_gives_the_same_frames(spark, tmp_path, name):
    (tmp_path / "x").write_bytes(ODD[name])
    split.register(spark)
    uri = f"file://{tmp_path}/x"
    read = spark.read.format("capture").option("rangeBytes", 3000).load(uri)
    assert read.rdd.getNumPartitions() >= 10
    whole = captures.frames(spark.createDataFrame([(uri, ODD[name])], "capture string, content binary"))
    assert rows(read) == rows(whole)


def test_ranges_skip_what_they_do_not_need(tmp_path):
    """The index pass reads a window a record at most: here a hundredth of the file."""
    big = tmp_path / "holes"
    record = 2 << 20
    with big.open("wb") as f:
        f.write(pcap([]))
        for i in range(100):
            f.write((100 + i).to_bytes(4, "little") + bytes(4) + record.to_bytes(4, "little") * 2)
            f.seek(record, 1)
        f.truncate()

    class Counting:
        def __init__(self, file):
            self.file, self.read = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

    with split.opened(f"file://{big}") as file:
        counted = Counting(file)
        found = list(split.spans(counted, 16 << 20))
    assert len(found) >= 12 and [s[2] for s in found] == sorted({s[2] for s in found})
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and found[-1][1] == big.stat().st_size
    assert counted.read <= 101 * split.WINDOW
