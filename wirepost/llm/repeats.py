"""What the two substring operators share: packed texts, keys counted once a batch, rows brought back to their text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import NULL_ID, mix, text_hash


def packed_texts(docs: DataFrame, tagged: bool) -> DataFrame:
    """(dk, th, blob): each text in UTF-8, compressed before it is shuffled; th is a 64-bit hash of it, or 0 if not tagged.

    Columns are declared not null, so that every join on dk and th reads one and the same shuffle of this table.
    """
    schema = T.StructType([T.StructField("dk", T.LongType(), False), T.StructField("th", T.LongType(), False), T.StructField("blob", T.BinaryType(), False)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            blobs = [pack(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(blobs, pa.binary())], ["dk", "th", "blob"])

    return hashed_texts(docs, tagged).mapInArrow(mapped, schema)


def hashed_texts(docs: DataFrame, tagged: bool) -> DataFrame:
    """(dk, th, text) with null ids as NULL_ID and null texts as empty; th is 0 if not tagged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th = text_hash(text) if tagged else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"), th.alias("th"), text.alias("text"))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two rows share an id. Where none do, rows need no hash of their text to be told apart, which makes every shuffled row shorter."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"))
    return not ids.groupBy("dk").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def unpack(blobs: pa.Array) -> Iterator[bytes]:
    take = zstandard.ZstdDecompressor().decompress
    return (take(x) for x in blobs.to_pylist())


def one_a_batch(keys: np.ndarray | tuple[np.ndarray, ...], *orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first row of each key (or of each combination of keys) by `orders`, how many rows it has, and the indices of all other rows.

    Only the first goes to the task that counts the key, so a key that is everywhere sends one row a batch there.
    """
    keys = keys if isinstance(keys, tuple) else (keys,)
    if not len(keys[0]):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((*reversed(orders), *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), order[~new]


def runs(row: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, number) of runs of neighbouring starts of a row."""
    order = np.lexsort((start, row))
    u, a = row[order], start[order]
    if not len(u):
        return
    cut = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (a[1:] != a[:-1] + 1)]))
    yield from zip(u[cut].tolist(), a[cut].tolist(), np.diff(np.append(cut, len(u))).tolist(), strict=True)


def marked(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    """(dk, th, at) rows as a batch."""
    cols = list(zip(*found, strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["dk", "th", "at"])


def by_doc(index: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(doc, values) with the rows of each doc together."""
    order = np.argsort(index, kind="stable")
    cuts = np.flatnonzero(np.diff(index[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(index[rows[0]]), [v[rows] for v in values]


def once_each(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch without rows that repeat both id and text hash."""
    _, first = np.unique(np.rec.fromarrays([batch.column("dk").to_numpy(), batch.column("th").to_numpy()]), return_index=True)
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def int_lists(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int32)))


def scattered(docs: np.ndarray) -> np.ndarray:
    """A partition key for rows that need no partner: spreads documents evenly."""
    return mix(docs.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def covered(starts: np.ndarray, lengths: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places the windows of `size` at starts[i], ..., starts[i] + lengths[i] - 1 cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths - 1 + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def own_columns(tagged: bool) -> list[str]:
    """What names a text: its id, and the hash of it where ids repeat."""
    return ["dk", "th"] if tagged else ["dk"]


def distinct_texts(rows: DataFrame, tagged: bool) -> DataFrame:
    """Of rows that repeat both id and text one."""
    return rows.dropDuplicates(["dk", "th"]) if tagged else rows


def together(marks: DataFrame, tagged: bool, *columns: str) -> DataFrame:
    """(k, kth if tagged, marks): the rows of marks (dk, th, ...) of one text in a list; its length is bounded by the text's."""
    names = own_columns(tagged)
    lists = marks.groupBy(*names).agg(F.collect_list(F.struct(*columns)).alias("marks"))
    return lists.select(*(F.col(a).alias(b) for a, b in zip(names, ("k", "kth"))), "marks")


def with_marks(texts: DataFrame, marks: DataFrame, tagged: bool, how: str) -> DataFrame:
    met = F.col("dk") == F.col("k")
    return texts.join(marks, met & (F.col("th") == F.col("kth")) if tagged else met, how).select("dk", "th", "blob", "marks")


def columns_of(lists: pa.Array, names: list[str]) -> Iterator[list[np.ndarray]]:
    """For each row of a list of structs, its fields as arrays; null lists are empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
    at = 0
    for n in [x or 0 for x in _lengths(lists)]:
        yield [f[at : at + n] for f in fields]
        at += n


def _lengths(lists: pa.Array) -> list[int | None]:
    return pc.list_value_length(lists).to_pylist()
