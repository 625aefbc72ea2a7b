"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import NULL_ID, blocks, byte_values, doc_id, fresh, keyed, materialize, same_keys, text_hash

SEED = 42


def bit_majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        bits = np.unpackbits(h[at : at + 16384].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the lower-cased (A-Z) words, repeats included."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined] if words else []
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: bytes, width: int = 3) -> int:
    """The signed 64-bit fingerprint; zero if there is no word."""
    h = shingle_hashes(text, width)
    return bit_majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(dk, th, fp) for each row of docs (doc_id, text); th is a hash of the text, which tells rows that share an id apart."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4_000_000):
            texts = byte_values(batch.column("text"))
            fps = [fingerprint(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(fps, pa.int64())], ["dk", "th", "fp"])

    return keyed(docs, hashed=True).mapInArrow(mapped, "dk long, th long, fp long")


def block_keys(fp: Column, parts: int, shared: int) -> Column:
    """One (table, key) for each choice of `shared` of the `parts` blocks of a fingerprint: key keeps those blocks' bits and no others."""
    width, out = 64 // parts, []
    for t, chosen in enumerate(combinations(range(parts), shared)):
        mask = sum(((1 << (width if i < parts - 1 else 64 - width * i)) - 1) << (width * i) for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        out.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


def close_pairs(fps: DataFrame, radius: int = 2, most: int = 256) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints fps (fp long) within `radius` (1 or 2) bits, each at most `radius` apart.

    With radius + 2 blocks any such pair has two blocks in common, so it meets under one key at least; Hamming distance then
    verifies. A block with more than `most` fingerprints is not paired: its members meet at the fingerprints within one bit
    of them instead. Two fingerprints have such a place in common exactly if they differ in two bits at most, and a place has
    65 members at most, so the links to its smallest member are few and lose no connection.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    fp = F.col("fp")
    table = fps.select("fp", F.inline(block_keys(fp, radius + 2, 2)))
    sizes = table.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("t2"), F.col("key").alias("key2"), "n")
    shared = materialize(table.join(sizes, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2"))).select("t", "key", "fp", "n"), "blocks")
    small = shared.where(F.col("n") <= most)
    other = small.select(F.col("t").alias("t2"), F.col("key").alias("key2"), F.col("fp").alias("b"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    met = (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")) & (fp < F.col("b")) & near(fp, F.col("b"))
    pairs = small.join(other, met).select(fp.alias("a"), "b")
    places = F.concat(F.array(fp), *[F.array(fp.bitwiseXOR(F.lit((1 << i) - ((1 << i) >> 63 << 64)).cast("long"))) for i in range(64)])
    crowd = shared.where(F.col("n") > most).select("fp").distinct().select("fp", F.explode(places).alias("place"))
    stars = crowd.groupBy("place").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where(F.col("a") < F.col("b"))
    return pairs.unionByName(stars.where(near(F.col("a"), F.col("b")))).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Words are what white space (ASCII) leaves, A-Z lower-cased; shingles have `width` words, repeats included, and a text with
    fewer words is one shingle. A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Texts
    without words (null and empty ones too) have fingerprint zero and are linked like any other. Fingerprints with at most
    `radius` differing bits are linked; component_id is the smallest doc_id reachable. Copies meet in one fingerprint before
    any pairing. Repeated rows each give a row; a null id stays null and is no component_id unless all ids of its component
    are null. An empty table gives none.
    """
    labelled, _ = _labelled(docs, width, radius)
    return labelled.select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("cid").alias("component_id"))


def _labelled(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    fps = materialize(fingerprints(docs, width), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min(F.when(F.col("dk") != NULL_ID, F.col("dk"))).alias("first"))
    groups = components(close_pairs(firsts.select("fp"), radius))
    linked = firsts.join(groups, F.col("fp") == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("least")).select(F.col("root").alias("root2"), "least")
    found = linked.join(smallest, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "root", "least")
    by_fp = firsts.join(found, F.col("fp") == F.col("fp2"), "left").select(
        F.col("fp").alias("fp3"), F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("cid")
    )
    return fps.join(by_fp, same_keys(("fp", "fp3"))).select("dk", "th", "fp", "root", "cid"), fps


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, all columns, of which one of each component of near_duplicates() stays: the one with the smallest doc_id.

    Of rows that share this id the text with the smaller hash stays, of equal rows one. Rows with null ids stay only if
    their component has no id.
    """
    labelled, _ = _labelled(docs, width, radius)
    last = F.when(F.col("dk") == NULL_ID, F.lit(2**63 - 1)).otherwise(F.col("dk"))
    kept = labelled.groupBy("root").agg(F.min(F.struct(last.alias("last"), F.col("dk"), F.col("th"))).alias("k")).select("k.dk", "k.th")
    return one_row_each(docs, kept)


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are in kept (dk, th); one of repeated ones."""
    dk, th, kdk, kth, n = fresh(docs, "dk", "th", "kdk", "kth", "n")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(dk, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(th, text_hash(text))
    met = rows.join(kept.select(F.col("dk").alias(kdk), F.col("th").alias(kth)), (F.col(dk) == F.col(kdk)) & (F.col(th) == F.col(kth)))
    first = Window.partitionBy(dk, th).orderBy(dk)
    return met.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
