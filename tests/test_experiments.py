"""Experiments by key: seeded forests, overlaps and ranks against loops over the same rows."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from wirepost.operators import experiments


def test_forests_of_seeds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(900)] + [(1000 + i, [8.0 + i, -9.0, 7.0, None if i == 0 else 9.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    grown = experiments.forests(df, [1, 2, 3], 60).persist()
    assert grown.groupBy("seed").count().collect() and {r["count"] for r in grown.groupBy("seed").count().collect()} == {60}
    scores = experiments.isolation(df, grown).persist()
    chosen = experiments.tops(scores.withColumnRenamed("isolation", "score"), ["seed"], 4)
    sets = {}
    for r in chosen.collect():
        sets.setdefault(r.seed, set()).add(r.id)
    assert all(len(s & set(range(1000, 1004))) >= 3 for s in sets.values()) and len(sets) == 3
    told = experiments.stability(chosen).first()
    assert told.pairs == 3 and abs(told.jaccard - np.mean([len(a & b) / len(a | b) for a, b in combinations(sets.values(), 2)])) < 1e-9
    again = experiments.forests(df.repartition(7), [1, 2, 3], 60)
    assert {(r.seed, r.tree, tuple(r.nodes)) for r in again.collect()} == {(r.seed, r.tree, tuple(r.nodes)) for r in grown.collect()}
    assert experiments.forests(df.limit(0), [1], 5).count() == 0


def test_each_tree_has_its_share(spark):
    """Of many rows each tree takes about GROWN_FROM: leaves hold the rows of a tree, so their number bounds it."""
    df = spark.range(4000).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    leaves = [sum(n[0] < 0 for n in np.array(r.nodes).reshape(-1, 5)) for r in experiments.forests(df, [5], 20).collect()]
    assert len(leaves) == 20 and 60 < min(leaves) and max(leaves) < 330


def test_overlaps_by_group(spark):
    rng = random.Random(5)
    rows = [(g, s, i) for g in range(3) for s in range(4) for i in rng.sample(range(12), 5)]
    got = {r.g: (r.pairs, r.jaccard) for r in experiments.stability(spark.createDataFrame(rows, "g int, seed int, id int"), ["g"]).collect()}
    for g in range(3):
        sets = [{i for a, b, i in rows if (a, b) == (g, s)} for s in range(4)]
        want = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
        assert got[g][0] == 6 and abs(got[g][1] - sum(want) / 6) < 1e-9
    apart = spark.createDataFrame([(1, 1), (2, 2)], "seed int, id int")
    assert experiments.stability(apart).first().jaccard == 0.0


def test_ranks_of_plants(spark):
    rng = random.Random(6)
    test = [("m", i, float(rng.randrange(5))) for i in range(40)] + [("n", i, 0.0) for i in range(40)]
    plants = [("m", "a", 3.0), ("m", "b", 9.0), ("n", "a", 0.0), ("n", "b", 0.1)]
    found = experiments.recall(spark.createDataFrame(test, "mask string, id int, score double"), spark.createDataFrame(plants, "mask string, id string, score double"), 10)
    want = {(m, k, sum(t[2] >= s for t in test if t[0] == m) + 1, 41) for m, k, s in plants}
    got = {(r.mask, r.kind, r.rank, r.total) for r in found.collect()}
    assert got == want and ("n", "a", 41, 41) in got  # a detector that says nothing ranks nothing first
