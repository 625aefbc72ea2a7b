"""Line dedup: hash windows of consecutive lines, find those that occur earlier, remove the lines that later occurrences cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, fresh, keyed, same_keys, text_hash


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(dk, th, pos, h1, h2): each window of `size` consecutive lines by two 64-bit hashes; texts with fewer lines have none."""
    lines = keyed(docs, hashed=True).select("dk", "th", split_lines(F.col("text")).alias("lines")).where(F.size("lines") >= size)
    at = lambda i: [F.element_at("lines", i + k) for k in range(1, size + 1)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - size),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit(1), *reversed(at(i))).alias("h2")),
    )
    return lines.select("dk", "th", F.inline(each))


def covered_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """(dk, th, covered array<int>): the lines (from 0) that later occurrences of repeated windows cover; only texts that have any."""
    every = windows(docs, size)
    place = F.struct("dk", "th", "pos")
    firsts = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = firsts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = every.join(firsts, same_keys(("h1", "g1"), ("h2", "g2"))).where(place > F.col("first"))
    starts = later.groupBy("dk", "th").agg(F.collect_set("pos").alias("starts"))
    merged = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + size - 1))))
    return starts.select("dk", "th", merged.alias("covered"))


def drop_repeated_lines(docs: DataFrame, size: int = 3, removed: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with text less the lines that later occurrences of a window of `size` lines cover.

    Lines are what newlines separate, empty ones included. A window occurs later if the same lines stand earlier: in a row
    with a smaller doc_id (null ids rank first; of one id, the smaller text hash), or in the same text before it. Windows are
    judged on the input. Rows that repeat both id and text count as one document and get one result; texts with fewer than
    `size` lines, null and empty texts stay as they are; a text that loses all its lines becomes empty. `removed` names a
    column to add with the number of lines removed. An empty table gives none.
    """
    dk, th, kdk, kth, covered, lines = fresh(docs, "dk", "th", "kdk", "kth", "covered", "lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cuts = covered_lines(docs, size).select(F.col("dk").alias(kdk), F.col("th").alias(kth), F.col("covered").alias(covered))
    rows = docs.withColumn(dk, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(th, text_hash(text))
    met = rows.join(cuts, (F.col(dk) == F.col(kdk)) & (F.col(th) == F.col(kth)), "left").withColumn(lines, split_lines(text))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    new = F.when(F.col(covered).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    count = [] if removed is None else [F.coalesce(F.size(F.col(covered)), F.lit(0)).cast("long").alias(removed)]
    return met.select(*((new.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns), *count)


def line_digests(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of drop_repeated_lines(): lines before, lines removed, SHA-256 of the text that stays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = drop_repeated_lines(docs.select("doc_id", text.alias("text"), F.size(split_lines(text)).cast("long").alias("n_lines")), size, removed="n_removed")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))



