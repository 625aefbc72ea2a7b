"""Anomaly scores over a feature table (id, feature, value): one row per cell, so that every statistic is a grouped aggregate.

A null value is unobservable: it takes no part in a fit and adds nothing to a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BINS = 10


def varying(cells: DataFrame) -> DataFrame:
    """(feature): features with several values that aren't all equal."""
    return cells.groupBy("feature").agg(F.count("value").alias("n"), (F.max("value") - F.min("value")).alias("range")).where("n > 1 and range > 0").select("feature")


def counted(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, column, same): how many rows have each value; nulls don't count."""
    return values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("same"))


def places(counts: DataFrame, by: list[str], column: str, parts: int = 100) -> DataFrame:
    """(by, column, same, below, total): for each value of counted() the rows of its group that are smaller, and all of them.

    Counts are summed up in two levels, by ranges that a sketch of the group's values gives: a large group is many tasks, and
    none holds more than about a hundredth of its values.
    """
    edges = counts.groupBy(*by).agg(F.percentile_approx(column, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10 * parts)).alias("edges"))
    dealt = counts.join(edges, by).withColumn("part", F.size(F.filter("edges", lambda e: e < F.col(column)))).drop("edges")
    group = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "part").agg(F.sum("same").alias("all"))
    sums = sums.withColumns({"before": F.sum("all").over(group.orderBy("part")) - F.col("all"), "total": F.sum("all").over(group)}).drop("all")
    inside = F.sum("same").over(Window.partitionBy(*by, "part").orderBy(column)) - F.col("same")
    return dealt.withColumn("inside", inside).join(sums, [*by, "part"]).select(*by, column, "same", (F.col("before") + F.col("inside")).alias("below"), "total")


def quantiles(counts: DataFrame, by: list[str], column: str, **shares: float) -> DataFrame:
    """(by, a column for each share): exact quantiles of counted() values, with linear interpolation between neighbours."""
    at = lambda i: F.min(F.when(F.col("below") + F.col("same") > i, F.col(column)))
    out = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return places(counts, by, column).groupBy(*by).agg(*out)


def histogram(cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(feature, low, high, bins, outside, densities): equal bins by the Freedman-Diaconis width, 2 to 10, smoothed by alpha, with one bucket kept for values outside.

    Constant features have no row. densities is a map from bin to density.
    """
    stats = cells.where("value is not null").groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    stats = stats.join(quantiles(counted(cells, ["feature"], "value"), ["feature"], "value", q1=0.25, q3=0.75), "feature")
    width = 2 * (F.col("q3") - F.col("q1")) / F.cbrt("n")
    fits = F.when(width > 0, F.greatest(F.lit(2), F.least(F.lit(MAX_BINS), F.ceil((F.col("high") - F.col("low")) / width).cast("int")))).otherwise(2)
    edges = stats.where("high > low").withColumn("bins", fits)
    counts = cells.where("value is not null").join(edges, "feature").groupBy("feature", "low", "high", "bins", "n", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("c"))
    whole = F.col("n") + alpha * (F.col("bins") + 1)
    table = counts.groupBy("feature", "low", "high", "bins", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", ((F.col("c") + alpha) / whole).alias("d"))))).alias("densities"))
    return table.select("feature", "low", "high", "bins", (alpha / whole).alias("outside"), "densities")


def bin_of(value: Column) -> Column:
    """The bin of a value between low and high, the last one closed on the right."""
    share = (value - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")
    return F.least(F.floor(share).cast("int"), F.col("bins") - 1)


def contributions(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, feature, part): -ln of a value's density; bins without a value and values outside have the smoothed minimum, null values zero."""
    met = cells.join(fitted, "feature")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    density = F.when(outside, F.col("outside")).otherwise(F.coalesce(F.try_element_at("densities", bin_of(F.col("value"))), F.col("outside")))
    return met.select("id", "feature", F.when(F.col("value").isNull(), 0.0).otherwise(-F.log(density)).alias("part"))


def scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(F.sum("part").alias("score"))


def robust(values: DataFrame, column: str = "score") -> DataFrame:
    """One row (median, mad): exact medians, the second times 1.4826."""
    counts = counted(values.withColumn("_all", F.lit(0)), ["_all"], column)
    center = quantiles(counts, ["_all"], column, median=0.5)
    apart = counts.join(center, "_all").groupBy("_all", "median", F.abs(F.col(column) - F.col("median")).alias("_off")).agg(F.sum("same").alias("same"))
    return quantiles(apart, ["_all", "median"], "_off", mad=0.5).select("median", (F.col("mad") * 1.4826).alias("mad"))


def standardized(values: DataFrame, scale: DataFrame, column: str = "score") -> DataFrame:
    """values with z: zero where the spread is none, so that a component without spread never speaks. scale has one row."""
    met = values.withColumn("_all", F.lit(0)).join(scale.withColumn("_all", F.lit(0)), "_all")
    z = F.when((F.col("mad") > 0) & ~F.isnan("mad"), (F.col(column) - F.col("median")) / F.col("mad")).otherwise(0.0)
    return met.select(*values.columns, z.alias("z"))


def counted_below(values: DataFrame, by: str, column: str) -> DataFrame:
    """values with below (rows of the group with a smaller value), same (with an equal one) and total: counts of distinct values meet, not rows."""
    return values.join(places(counted(values, [by], column), [by], column), [by, column])


def quantile_higher(values: DataFrame, by: str, column: str, q: float) -> DataFrame:
    """(by, threshold): the value at index ceil(q (n - 1)) in ascending order, without interpolation."""
    far = F.col("below") + F.col("same") > F.ceil((F.col("total") - 1) * F.lit(q))
    return places(counted(values, [by], column), [by], column).where(far).groupBy(by).agg(F.min(column).alias("threshold"))


def top_factors(parts: DataFrame, k: int = 3) -> DataFrame:
    """(id, rank, feature, part): the k largest positive contributions of each id, equal ones by name."""
    order = Window.partitionBy("id").orderBy(F.desc("part"), "feature")
    return parts.where("part > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "feature", "part")


def applied(scores: DataFrame, by: str, clean: Column, q: float = 0.99) -> DataFrame:
    """(id, score, is_anomaly, percentile, disagrees): scores (id, by, score) against the threshold of their group; an anomaly that no rule finds (`clean`) disagrees with the rules."""
    limits = quantile_higher(scores, by, "score", q)
    placed = counted_below(scores, by, "score").join(limits, by)
    flagged = F.col("score") >= F.col("threshold")
    percentile = 100 * (F.col("below") + 0.5 * F.col("same")) / F.col("total")
    return placed.select("id", "score", flagged.alias("is_anomaly"), percentile.alias("percentile"), (flagged & clean).alias("disagrees"))
