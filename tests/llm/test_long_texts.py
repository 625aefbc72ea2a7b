"""Texts longer than what the operators hold at a time: segments, blocks of shingles, runs of windows, records."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from test_operators import brute_suffixes, collected, words
from wirepost.llm import decontaminate, quality, simhash, substrings, suffixes, warc


def test_repeats_across_the_segments_of_a_text(spark):
    rng = random.Random(31)
    passage = words(rng, 60)
    text = words(rng, 150_000)
    at = suffixes.SEGMENT - 200
    text = text[:at] + " " + passage + " " + text[at:] + " " + passage
    rows = [(1, text), (2, "short " + passage), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(text) > suffixes.SEGMENT + 1000
    assert collected(suffixes.suffix_digests(docs)) == brute_suffixes(rows, 100)
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    count = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    want = Counter()
    for doc, w in split.items():
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    assert collected(substrings.substring_digests(docs)) == want


def test_fingerprint_of_many_shingles():
    rng = random.Random(32)
    text = words(rng, 40_000)
    ws = text.split()
    counts = np.zeros(64, int)
    for i in range(len(ws) - 2):
        h = xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42)
        counts += [h >> b & 1 for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(ws) - 2)
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want


def test_an_item_in_a_long_run_of_its_own_shingles(spark):
    rng = random.Random(33)
    item = "one two three four five six seven " * 4
    text = "one two three four five six eight " * 3000 + item + words(rng, 5000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (found,) = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert found.similarity == 1.0 and found.first_word == 21_000


def test_a_long_text_counts_as_its_parts_do():
    rng = random.Random(34)
    text = words(rng, 50_000)
    half = text.split()[:25_000], text.split()[25_000:]
    whole = Counter(quality.features(text.encode(), 1 << 20).tolist())
    parts = sum((Counter(quality.features(" ".join(h).encode(), 1 << 20).tolist()) for h in half), Counter())
    assert (whole - parts).total() == 2 and not parts - whole  # two pairs stand across the cut


def test_a_long_record(spark, tmp_path):
    html = words(random.Random(35), 900_000)
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "x")], "page_id long, url string, html string")
    rows = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages, path=str(tmp_path / "w")).collect()}
    assert rows == {1: (len(html), "response", None), 2: (len(html), "revisit", 1), 3: (1, "response", None)}
