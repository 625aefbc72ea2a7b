"""Many texts under one id: each text's marks stay its own."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from test_operators import collected, words
from wirepost.llm import repeats, substrings, suffixes


def test_marks_are_grouped_by_text(spark):
    rng = random.Random(8)
    line = words(rng, 40)
    texts = [f"{words(rng, 5 + i)} {line} {words(rng, 9)}" for i in range(60)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])] * 20 + [(1, line)], "doc_id long, text string").repartition(3)
    split = {t: t.split() for t in [*texts, line]}
    marks = substrings.repeated_windows(docs, repeats.packed_texts(docs, True), 35, True)
    lists = marks.collect()
    assert len(lists) == len(split)
    assert max(sum(len(m.at) for m in r.marks) for r in lists) <= max(map(len, split.values()))
    count = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    want = Counter()
    for doc, t in [*((None, t) for t in texts), *[(None, texts[0])] * 20, (1, line)]:
        w = split[t]
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert collected(substrings.substring_digests(docs, 35)) == want
    spans = {(r.doc_id, r.n_spans) for r in suffixes.suffix_digests(docs, 100).collect()}
    assert spans <= {(None, 0), (None, 1), (1, 0), (1, 1)}


def test_texts_of_one_id_are_told_apart_by_64_bits(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    assert dict(repeats.packed_texts(docs, True).dtypes)["th"] == "bigint"
