"""Helpers that the corpus operators share: tables in the shared folder, Arrow batches, window hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an id rank before all others; their results carry a null id again.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and Spark runs on one machine."""
    conf = spark.sparkContext.getConf()
    known = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirepost-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, kind)
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.wirepost_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, when nothing reads it any more."""
    if path := getattr(df, "wirepost_path", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever else it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same_keys(*pairs: tuple[str, str]) -> Column:
    """A join condition on long columns whose sides are both dealt for the join alone, so that Spark can split a hot key.

    A side that was grouped by the keys is already dealt by them, and what is dealt for two purposes is never split; the
    parity of the last key as one more condition asks for a dealing of its own.
    """
    (*_, (a, b)) = pairs
    met = F.pmod(F.col(a), F.lit(2)) == F.pmod(F.col(b), F.lit(2))
    for a, b in pairs:
        met = met & (F.col(a) == F.col(b))
    return met


def text_hash(text: Column) -> Column:
    """Tells rows that share an id apart; equal rows stay equal."""
    return F.xxhash64(text)


def keyed(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(dk, text) or (dk, th, text): ids with null as NULL_ID, texts with null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dk = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk")
    return docs.select(dk, *[text_hash(text).alias("th")] * hashed, text.alias("text"))


def doc_id(dk: str = "dk") -> Column:
    return F.when(F.col(dk) != NULL_ID, F.col(dk)).alias("doc_id")


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column, without decoding it; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` (one row at least), so that scratch arrays stay small."""
    for batch in batches:
        sizes = np.cumsum([0] + [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of window hashes, whose low bits depend on few positions."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(values: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hash of each window of `length` 64-bit values, by doubling; empty if there are fewer."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = values, 1, factor & (2**64 - 1)
    out, at = None, 0
    while True:
        part, size, c = power
        if length & size:
            piece = part[at : at + n]
            out = piece if out is None else out * np.uint64(c) + piece
            at += size
        if size * 2 > length:
            return mix(out)
        power = part[: len(part) - size] * np.uint64(c) + part[size:], size * 2, c * c & (2**64 - 1)
