"""Experiments on anomaly models as one job: a key for each seed, component mask and planted kind, all fitted and scored side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import anomaly
from .forest import GROWN_FROM, TREES, average_path, grown, path_length

TREE = "seed int, tree int, nodes array<double>"


def forests(vectors: DataFrame, seeds: list[int], trees: int = TREES) -> DataFrame:
    """TREE: trees of a forest for each seed, grown in tasks by (seed, tree) from vectors (id, features array<double>).

    A row goes to a tree with the chance that gives it about GROWN_FROM rows; seed and id decide, so the same table gives the
    same trees however it is dealt. Only the rows that some tree takes are shuffled. Nulls count as -1.
    """
    total = vectors.count()
    chance = min(1.0, GROWN_FROM / max(1, total))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (1 - chance) ** trees
        for batch in batches:
            hashes = batch.column("h").to_numpy().view(np.uint64)
            out: list[tuple[int, int, int]] = []
            for seed in seeds:
                x = hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                u = ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2**53
                for row in np.flatnonzero(u >= none).tolist():  # only rows that some tree takes are looked at one by one
                    rng = np.random.default_rng([seed, int(hashes[row])])
                    taken = np.flatnonzero(rng.random(trees) < chance)
                    while not len(taken):
                        taken = np.flatnonzero(rng.random(trees) < chance)
                    out += [(seed, int(t), row) for t in taken]
            if out:
                s, t, at = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(t, pa.int32()), batch.column("h").take(pa.array(at)), batch.column("features").take(pa.array(at))], ["seed", "tree", "h", "features"])

    def grow(table: pa.Table) -> pa.Table:
        seed, tree = table["seed"][0].as_py(), table["tree"][0].as_py()
        own = table.sort_by("h")
        rows = np.array([[-1.0 if x is None or x != x else x for x in v] for v in own["features"].to_pylist()], float)
        nodes = grown(rows, np.random.default_rng([seed, tree]))
        return pa.table({"seed": pa.array([seed], pa.int32()), "tree": pa.array([tree], pa.int32()), "nodes": pa.array([nodes.ravel().tolist()], pa.list_(pa.float64()))})

    rows = vectors.select(F.xxhash64("id").alias("h"), "features").mapInArrow(dealt, "seed int, tree int, h long, features array<double>")
    return rows.groupBy("seed", "tree").applyInArrow(grow, TREE)


def isolation(vectors: DataFrame, grown_trees: DataFrame) -> DataFrame:
    """(id, seed, isolation) for each row and seed. The trees have a size that seeds, trees and GROWN_FROM fix (20 KB each), so they are handed to all tasks."""
    by_seed: dict[int, list[np.ndarray]] = {}
    for r in grown_trees.orderBy("seed", "tree").toArrow().to_pylist():
        by_seed.setdefault(r["seed"], []).append(np.array(r["nodes"]).reshape(-1, 5))
    shared = vectors.sparkSession.sparkContext.broadcast(by_seed)
    kind = dict(vectors.dtypes)["id"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = float(average_path(np.array(GROWN_FROM)))
        for batch in batches:
            rows = np.array([[-1.0 if x is None or x != x else x for x in v] for v in batch.column(1).to_pylist()], float)
            for seed, trees in shared.value.items():
                paths = sum((path_length(t, rows) for t in trees), np.zeros(len(rows))) / len(trees)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), seed, np.int32)), pa.array(2.0 ** (-paths / usual))], ["id", "seed", "isolation"])

    return vectors.select("id", "features").mapInArrow(mapped, f"id {kind}, seed int, isolation double")


def tops(scores: DataFrame, by: list[str], k: int, score: str = "score") -> DataFrame:
    """(by, id): the k highest of each group, ties to the smaller id; Spark keeps k rows a task before the shuffle."""
    place = Window.partitionBy(*by).orderBy(F.desc(score), "id")
    return scores.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).select(*by, "id")


def stability(chosen: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, pairs, jaccard): mean overlap of the sets that seeds chose (by, seed, id), over all pairs of seeds; pairs without a common row count as zero."""
    sizes = chosen.groupBy(*by, "seed").agg(F.count("*").alias("n"))
    one = lambda k: sizes.select(*(F.col(c).alias(f"{c}{k}") for c in (*by, "seed", "n")))
    same = lambda *names: [F.col(f"{c}1") == F.col(f"{c}2") for c in names]
    pairs = one(1).join(one(2), (F.col("seed1") < F.col("seed2")) if not by else (F.col("seed1") < F.col("seed2")) & F.expr(" AND ".join(f"{c}1 = {c}2" for c in by)))
    row = lambda k: chosen.select(*(F.col(c).alias(f"{c}{k}") for c in (*by, "seed", "id")))
    met = row(1)
    other = row(2)
    cond = F.col("seed1") < F.col("seed2")
    for c in same(*by, "id"):
        cond = cond & c
    common = met.join(other, cond).groupBy(*(f"{c}1" for c in by), "seed1", "seed2").agg(F.count("*").alias("common"))
    common = common.select(*(F.col(f"{c}1").alias(f"{c}_") for c in by), F.col("seed1").alias("a"), F.col("seed2").alias("b"), "common")
    key = (F.col("seed1") == F.col("a")) & (F.col("seed2") == F.col("b"))
    for c in by:
        key = key & (F.col(f"{c}1") == F.col(f"{c}_"))
    every = pairs.join(common, key, "left").withColumn("common", F.coalesce("common", F.lit(0)))
    share = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    return every.groupBy(*(F.col(f"{c}1").alias(c) for c in by)).agg(F.count("*").alias("pairs"), F.avg(share).alias("jaccard"))


def planted(cells: DataFrame, kinds: dict[str, dict[int, Column]]) -> DataFrame:
    """(kind, feature, value): the row of cells (id, feature, value) with most values (then the smallest id), with some features
    set anew for each kind; a setting may use high, the largest value of its feature."""
    base = cells.groupBy("id").agg(F.count("value").alias("seen")).agg(F.min_by("id", F.struct(-F.col("seen"), "id")).alias("base"))
    highs = cells.groupBy("feature").agg(F.max("value").alias("high"))
    own = cells.join(base, F.col("id") == F.col("base")).select("feature", "value").join(highs, "feature")
    each = own.select("feature", "value", "high", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    value = F.col("value")
    for kind, settings in kinds.items():
        for feature, to in settings.items():
            value = F.when((F.col("kind") == kind) & (F.col("feature") == feature), to).otherwise(value)
    return each.select("kind", "feature", value.alias("value"))


def component_scores(cells: DataFrame, fitted: DataFrame, component: Column) -> DataFrame:
    """(id, component, score): contributions of fitted histograms summed up by component of the features."""
    parts = anomaly.contributions(cells.select("id", "feature", "value"), fitted)
    return parts.groupBy("id", component.alias("component")).agg(F.round(F.sum("part"), 6).alias("score"))


def scales(scores: DataFrame) -> DataFrame:
    """(component, median, mad): exact medians and deviations, the second times 1.4826, of each component."""
    counts = anomaly.counted(scores, ["component"], "score")
    center = anomaly.quantiles(counts, ["component"], "score", median=0.5)
    apart = counts.join(center, "component").groupBy("component", "median", F.abs(F.col("score") - F.col("median")).alias("off")).agg(F.sum("same").alias("same"))
    return anomaly.quantiles(apart, ["component", "median"], "off", mad=0.5).select("component", "median", (F.col("mad") * 1.4826).alias("mad"))


def ensembles(scores: DataFrame, scale: DataFrame, masks: dict[str, list]) -> DataFrame:
    """(mask, id, score): for each mask the largest standardised score among its components that have a spread, zero if none has."""
    z = F.when(F.col("mad") > 0, (F.col("score") - F.col("median")) / F.col("mad"))
    named = scores.join(scale, "component").withColumn("z", F.round(z, 6))
    of = F.array_compact(F.array(*(F.when(F.col("component").isin(*parts), F.lit(mask)) for mask, parts in masks.items())))
    return named.select("id", "z", F.explode(of).alias("mask")).groupBy("mask", "id").agg(F.coalesce(F.max("z"), F.lit(0.0)).alias("score"))


def recall(test: DataFrame, plants: DataFrame, k: int = 10) -> DataFrame:
    """(mask, kind, rank, total, in_top): the conservative rank of each plant (mask, id, score) among the test rows (mask, id, score) and itself: ties rank before it."""
    one = plants.select(F.col("mask").alias("mask2"), F.col("id").alias("kind"), F.col("score").alias("own"))
    met = test.join(one, F.col("mask") == F.col("mask2"))
    told = met.groupBy("mask", "kind").agg((F.count_if(F.col("score") >= F.col("own")) + 1).alias("rank"), (F.count("*") + 1).alias("total"))
    return told.withColumn("in_top", F.col("rank") <= k)
