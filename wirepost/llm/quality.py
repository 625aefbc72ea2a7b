"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, their ratio, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, blocks, byte_values, discard, fresh, keyed, materialize, text_hash, word_hashes

#: Fixed value: factor that joins the hashes of two neighbouring words.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Labelled rows that fit the model at most, chosen by a hash of the id; half name the target text, half set the cut.
LABELLED = 20_000
#: Buckets for each square root of a byte of text, and how many of them one pass over the texts holds.
DENSITY, SLICE = 16, 1 << 22
#: Expected occurrences that a bucket must have before its ratio is believed by half.
PRIOR = 10.0
#: Rows among which the last one of a sample is looked up by sorting.
FEW = 10_000
#: Class of each byte: white space, lower case, upper case, digit, other ASCII, part of a non-ASCII character.
CLASS = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5 for b in range(256)], np.uint64)


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the n-grams of docs, a power of two: as the vocabulary of a corpus does, they grow with the root of its size."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    return 1 << max(15, int(np.ceil(np.log2(max(1.0, DENSITY * size**0.5)))))


def features(text: bytes, buckets: int, shapes: bool = True) -> np.ndarray:
    """Buckets of a text's n-grams: its words and pairs of neighbouring words as they stand; with shapes also the words' shapes, and pairs of these with whether the word is repeated.

    A shape is the class of the first two bytes and the last byte, so that it says how words are cased, marked and ended
    whatever the vocabulary.
    """
    h = word_hashes(text.split())
    if not len(h):
        return np.empty(0, np.int64)
    found = [h, (h[:-1] ^ (h[1:] >> np.uint64(7))) * FACTOR + h[1:]]
    if shapes:
        data = np.frombuffer(text, np.uint8)
        inside = np.concatenate([[False], CLASS[data] > 0, [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        first, second, last = data[starts], data[np.minimum(starts + 1, ends - 1)], data[ends - 1]
        shape = ((CLASS[first] * np.uint64(8) + CLASS[second]) * np.uint64(256) + last + np.uint64(1)) * FACTOR
        found += [shape, (shape[:-1] * FACTOR + shape[1:] + (h[:-1] == h[1:])) * FACTOR]
    every = np.concatenate(found)
    every ^= every >> np.uint64(33)
    return (every % np.uint64(buckets)).astype(np.int64)


def labelled_sample(labels: DataFrame, most: int) -> tuple[dict[int, int], dict[int, int]]:
    """doc_id -> quality of at most `most` labelled rows: the half that fits the target model, and the half that sets the cut."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("q"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return {r.doc_id: r.q for r in rows[::2]}, {r.doc_id: r.q for r in rows[1::2]}


def slices(buckets: int) -> list[tuple[int, int]]:
    return [(lo, min(buckets, lo + SLICE)) for lo in range(0, buckets, SLICE)]


def ngram_counts(docs: DataFrame, target: set[int], buckets: int, shapes: bool = True) -> DataFrame:
    """(bucket, raw, own): counts over all of docs, and over those of the target rows. Each task adds up its own first, a slice of the buckets at a time."""
    ids = docs.sparkSession.sparkContext.broadcast(target)

    def counter(lo: int, hi: int):
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, own = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)

            def add(to: np.ndarray, found: list[np.ndarray]) -> None:
                f = np.concatenate([np.empty(0, np.int64), *found])
                np.add(to, np.bincount(f[(f >= lo) & (f < hi)] - lo, minlength=hi - lo), out=to)

            for batch in blocks(batches, "text", 1_000_000):
                found = [features(t, buckets, shapes) for t in byte_values(batch.column("text"))]
                add(raw, found)
                if mine := [f for f, dk in zip(found, batch.column("dk").to_pylist(), strict=True) if dk in ids.value]:
                    add(own, mine)
            some = np.flatnonzero(raw)
            for at in range(0, len(some), 100_000):
                part = some[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + lo), pa.array(raw[part]), pa.array(own[part])], ["bucket", "raw", "own"])

        return mapped

    passes = [keyed(docs).mapInArrow(counter(lo, hi), "bucket long, raw long, own long") for lo, hi in slices(buckets)]
    return reduce(DataFrame.unionByName, passes).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own"))


def log_ratio(raw: np.ndarray, own: np.ndarray, share: float) -> np.ndarray:
    """log p_target / p_raw per bucket, share being the target's part of all n-grams; buckets that the target text would rarely use are drawn towards equality."""
    return np.log((own + PRIOR) / (raw * share + PRIOR))


def scores(docs: DataFrame, counts: DataFrame, buckets: int, shapes: bool = True) -> DataFrame:
    """(dk, th, n, weight): n-grams of each row of docs, and the sum of their log ratios, for counts (bucket, raw, own)."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("own"), F.lit(0)).alias("own")).first()
    share = total.own / max(1, total.raw)

    def scorer(lo: int, hi: int):
        table = counts.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).toArrow()  # at most SLICE rows
        ratio = np.zeros(hi - lo, np.float32)
        if total.own:
            at = table["bucket"].to_numpy() - lo
            ratio[at] = log_ratio(table["raw"].to_numpy(), table["own"].to_numpy(), share)
        shared = spark.sparkContext.broadcast(ratio)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio = shared.value
            for batch in blocks(batches, "text", 1_000_000):
                found = [features(t, buckets, shapes) for t in byte_values(batch.column("text"))]
                found = [f[(f >= lo) & (f < hi)] - lo for f in found]
                weights = [float(ratio[f].sum(dtype=np.float64)) for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(map(len, found), pa.int64()), pa.array(weights)], ["dk", "th", "n", "weight"])

        return mapped

    parts = slices(buckets)
    passes = [keyed(docs, hashed=True).mapInArrow(scorer(lo, hi), "dk long, th long, n long, weight double") for lo, hi in parts]
    if len(parts) == 1:
        return passes[0]
    copies = (F.count("*") / len(parts)).cast("int")  # of rows that repeat id and text
    summed = reduce(DataFrame.unionByName, passes).groupBy("dk", "th").agg((F.sum("n") / copies).cast("long").alias("n"), (F.sum("weight") / copies).alias("weight"), copies.alias("copies"))
    return summed.select("dk", "th", "n", "weight", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def best_cut(scored: DataFrame, cutting: dict[int, int]) -> float:
    """The weight below which labelled rows of the cutting half are rejected: the one with the fewest errors, rejecting little in a tie. Of rows that share an id the one with the smallest hash counts."""
    shared = scored.sparkSession.createDataFrame([*cutting.items()] or [(0, 0)], "id long, q int")
    met = scored.where("n > 0").join(F.broadcast(shared), F.col("dk") == F.col("id"))
    rows = met.groupBy("id").agg(F.min("q").alias("q"), F.min_by("weight", "th").alias("weight")).collect()  # one for each label at most
    good = np.sort([r.weight for r in rows if r.q == 1])
    bad = np.sort([r.weight for r in rows if r.q == 0])
    if not len(good) or not len(bad):
        return -np.inf
    edges = np.unique(np.concatenate([good, bad]))
    errors = np.searchsorted(good, edges) + len(bad) - np.searchsorted(bad, edges)
    best = np.flatnonzero(errors == errors.min())
    i = int(best[0])
    return float(edges[i] if i == 0 else (edges[i - 1] + edges[i]) / 2)


def top_share(keys: DataFrame, k: int) -> tuple[int, int, int]:
    """The (key, dk, th) of the k-th row of keys (key, dk, th: longs) in descending order of key, ascending of dk and th.

    Narrows the range that holds it by counting 4096 parts of it at a time, until FEW rows are left that can be sorted; equal
    keys are told apart by dk, then th, likewise.
    """
    bounds = []
    for column, sign in (("key", -1), ("dk", 1), ("th", 1)):
        value = f"(CAST({'-' if sign < 0 else '+'}CAST({column} AS DECIMAL(20,0)) AS DECIMAL(20,0)))"
        lo, hi = sorted(sign * x for x in keys.agg(F.min(column), F.max(column)).first())
        while lo < hi:
            step = -(-(hi - lo + 1) // 4096)
            inside = keys.where(f"{value} >= {lo}BD AND {value} <= {hi}BD")
            counts = dict(inside.groupBy(F.expr(f"CAST(({value} - ({lo}BD)) DIV {step}BD AS INT)").alias("p")).count().collect())
            for p in sorted(counts):
                if counts[p] >= k:
                    break
                k -= counts[p]
            lo, hi = lo + p * step, min(hi, lo + (p + 1) * step - 1)
            if counts[p] <= FEW:
                rows = keys.where(f"{value} >= {lo}BD AND {value} <= {hi}BD").select("key", "dk", "th").collect()
                return tuple(sorted(rows, key=lambda r: (-r.key, r.dk, r.th))[k - 1])
        bounds.append(sign * lo)
        keys = keys.where(F.expr(f"{column} = CAST({bounds[-1]}BD AS BIGINT)"))
    return tuple(bounds)


def order_key(x: Column) -> Column:
    """A long that orders as the double does, to 2**-20 of its unit."""
    return F.round(x * 2.0**20).cast("long")


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise from a hash of (dk, th): the same each time a lost task runs again."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "dk", "th"), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 8, buckets: int | None = None, labelled: int = LABELLED, shapes: bool = True) -> DataFrame:
    """(dk, th, weight, key) of the k rows of docs (doc_id, text) that importance resampling draws, without replacement.

    The target model counts hashed n-grams (words, pairs of words, and shapes of both unless turned off) of labelled rows of
    quality 1, the raw model those of all of docs, in buckets whose number grows with docs unless it is given. Counts stay in a table of the shared folder; SLICE
    buckets at a time go to the tasks.
    weight is the sum of the log ratios of a text's n-grams; key adds Gumbel noise, and the k largest keys stay, ties to the
    smaller doc_id, then text hash. Without k, it is the number of rows whose weight reaches the cut that separates
    labelled rows of quality 1 and 0 with the fewest errors, so the sample is as large as the text that looks like target
    text. Labels come from at most `labelled` rows, chosen by a hash of doc_id; those with a null id or quality count as
    unlabelled, of several for an id the lowest counts. With no labelled text of either quality, all rows stay.

    Texts without words (null, empty) have weight 0 and stay if k reaches that far; without k they don't count, and stay only
    if all rows do. Rows that repeat id and text have equal keys and stay or go together. Null ids rank before others; they
    and the id -2**63 are the same. An empty table gives none.
    """
    fitting, cutting = labelled_sample(labels, labelled)
    buckets = buckets or bucket_count(docs)
    counts = materialize(ngram_counts(docs, {d for d, q in fitting.items() if q == 1}, buckets, shapes), "ngrams")
    scored = materialize(scores(docs, counts, buckets, shapes), "scores")
    discard(counts)
    keyed_rows = scored.select("dk", "th", "n", "weight", (order_key(F.col("weight") + gumbel(seed))).alias("key"))
    cut = best_cut(scored, cutting)
    total, fit = scored.agg(F.count("*"), F.count_if((F.col("n") > 0) & (F.col("weight") >= F.lit(cut)))).first()
    if k is None:
        k = total if cut == -np.inf else fit
        if k < total:
            keyed_rows = keyed_rows.where("n > 0")  # the cut counts texts with words only, so only they take places
    if k >= total:
        chosen = keyed_rows
    elif k <= 0:
        chosen = keyed_rows.where(F.lit(False))
    else:
        key, dk, th = top_share(keyed_rows.select("key", "dk", "th"), k)
        after = (F.col("key") > key) | ((F.col("key") == key) & (F.struct("dk", "th") <= F.struct(F.lit(dk).cast("long").alias("dk"), F.lit(th).cast("long").alias("th"))))
        chosen = keyed_rows.where(after)
    return chosen.select("dk", "th", "weight", (F.col("key") / 2.0**20).alias("key"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that resample() draws."""
    dk, th, kdk, kth = fresh(docs, "dk", "th", "kdk", "kth")
    kept = resample(docs, labels, **options).select(F.col("dk").alias(kdk), F.col("th").alias(kth))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(dk, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(th, text_hash(text))
    return rows.join(kept, (F.col(dk) == F.col(kdk)) & (F.col(th) == F.col(kth)), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
