"""Isolation forest over feature vectors: trees from a bounded sample, scores in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a tree is grown from, at most, and trees.
GROWN_FROM, TREES = 256, 200
EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """The mean length of an unsuccessful search in a binary tree of n rows, which path lengths are measured by."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One tree as (nodes, 5): feature (-1 for leaves), threshold, left, right, path length at a leaf. Splits are drawn between the extremes of a feature that varies."""
    deepest = int(np.ceil(np.log2(max(2, len(rows)))))
    nodes, todo = [], [(rows, 0, -1, 0)]
    while todo:
        own, depth, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        varied = np.flatnonzero(own.min(0) < own.max(0)) if depth < deepest and len(own) > 1 else []
        if not len(varied):
            nodes.append([-1, 0, 0, 0, depth + float(average_path(len(own)))])
            continue
        f = int(rng.choice(varied))
        cut = rng.uniform(own[:, f].min(), own[:, f].max())
        below = own[:, f] <= cut
        todo += [(own[~below], depth + 1, len(nodes), 1), (own[below], depth + 1, len(nodes), 0)]
        nodes.append([f, cut, 0, 0, 0])
    return np.array(nodes)


def path_length(tree: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = np.zeros(len(rows), np.int64)
    inner = tree[at, 0] >= 0
    while inner.any():
        node = tree[at[inner]]
        below = rows[inner, node[:, 0].astype(int)] <= node[:, 1]
        at[inner] = np.where(below, node[:, 2], node[:, 3]).astype(int)
        inner = tree[at, 0] >= 0
    return tree[at, 4]


def forest(vectors: DataFrame, seed: int = 42, trees: int = TREES) -> list[np.ndarray]:
    """Trees over vectors (id, features array<double>): each from GROWN_FROM rows of a pool of trees times as many, chosen by a hash of the id. Nulls count as -1."""
    pool = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(trees * GROWN_FROM).select("features").toArrow()
    rows = np.array([[-1.0 if x is None or x != x else x for x in v] for v in pool["features"].to_pylist()], float)
    rng = np.random.default_rng(seed)
    return [grown(rows[rng.choice(len(rows), min(GROWN_FROM, len(rows)), replace=False)], rng) for _ in range(trees if len(rows) else 0)]


def isolation(vectors: DataFrame, fitted: list[np.ndarray]) -> DataFrame:
    """(id, isolation): 2 to the minus of the mean path length by its average, close to 1 for rows that are easily set apart; 0 without trees."""
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)
    kind = dict(vectors.dtypes)["id"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        usual = float(average_path(min(GROWN_FROM, max((int((t[:, 0] < 0).sum()) for t in trees), default=2)))) or 1.0
        for batch in batches:
            rows = np.array([[-1.0 if x is None or x != x else x for x in v] for v in batch.column(1).to_pylist()], float)
            paths = sum((path_length(t, rows) for t in trees), np.zeros(len(rows))) / max(1, len(trees))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-paths / usual) if trees else np.zeros(len(rows)))], ["id", "isolation"])

    return vectors.select("id", "features").mapInArrow(mapped, f"id {kind}, isolation double")
