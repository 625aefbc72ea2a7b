"""Texts shorter than a benchmark item."""

from __future__ import annotations

import random
from collections import Counter

from test_operators import jaccard, words
from wirepost.llm import decontaminate


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(11)
    item = words(rng, 59).split()
    cuts = [59, 58, 55, 51, 49, 48, 47, 40, 3, 0]
    rows = [(n, " ".join(item[:n])) for n in cuts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {(n, 0, round(jaccard(shingles(item[:n]), shingles(item)), 9)) for n in cuts}
    got = {(r.doc_id, r.first_word, round(r.similarity, 9)) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {x for x in want if x[2] >= 0.8}
    assert {x[0] for x in got} == {59, 58, 55, 51, 49, 48}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()) == [0, 3, 40, 47]
