"""As-of matching without long windows: each key's rows are cut into buckets of time, so a hot key is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_match(rows: DataFrame, key: str, at: str, wanted: Column, value: str, bucket: Column) -> DataFrame:
    """rows with next_at and next_value: the first later row of the key (strictly, by `at`, which is unique in a key) that is wanted, else null.

    `bucket` must not decrease with `at`. Inside a bucket a window looks ahead; across buckets only each bucket's first
    wanted row matters, a table that is smaller by the bucket's size.
    """
    columns = rows.columns
    marked = rows.withColumns({"_b": bucket, "_w": F.when(wanted, F.struct(F.col(at).alias("next_at"), F.col(value).alias("next_value")))})
    ahead = Window.partitionBy(key, "_b").orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    near = marked.withColumn("_near", F.min("_w").over(ahead))
    firsts = marked.groupBy(key, "_b").agg(F.min("_w").alias("_first"))
    later = Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    far = firsts.select(F.col(key).alias("_k"), F.col("_b").alias("_b2"), F.min("_first").over(later).alias("_far"))
    met = near.join(far, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")))
    best = F.coalesce("_near", "_far")
    return met.select(*columns, best["next_at"].alias("next_at"), best["next_value"].alias("next_value"))
