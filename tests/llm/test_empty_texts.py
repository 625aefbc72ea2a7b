"""Tables full of texts without words."""

from __future__ import annotations

import random

from test_operators import words
from wirepost.llm import quality


def test_empty_texts_take_no_place(spark, monkeypatch):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the of and to in is was for on with".split()) + " " + words(rng, 1) for _ in range(40))
    bad = lambda: " ".join(words(rng, 1).upper() + "!!" for _ in range(60))
    rows = [(i, bad() if i % 6 == 0 else good()) for i in range(400)]
    rows += [(1000 + i, ("", None, " \n")[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "best_cut", lambda scored, cutting: -1e9)
    every = {r.dk for r in quality.resample(docs, labels).collect()}
    assert every == set(range(400))  # the cut is below every text with words
