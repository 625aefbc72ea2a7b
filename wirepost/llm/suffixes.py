"""Suffix-array dedup of bytes: repeated strings of a fixed length, found by two-stage suffix sorting, removed after their first place.

Equal strings of `length` bytes choose the same k-gram inside them, the one of least hash; a unit is a run of neighbouring
starts that choose the same place. So equal strings stand in units with one key, at one distance from it. Units whose key
occurs once hold no repeated string. Of identical units the first stays. What is left of a key are units that differ, and
these are suffix-sorted: whole keys together, many keys to a text of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import (
    by_doc, columns_of, covered, distinct_texts, hashed_texts, ids_repeat, int_lists, marked, once_each, one_a_batch, own_columns, packed_texts, runs, scattered, small_batches, together, unpack, with_marks
)
from .shared import blocks, byte_values, doc_id, materialize, mix, same_keys, window_hashes

#: Fixed value: factor of the k-grams' polynomial hash.
FACTOR = 0x9E3779B97F4A7C15
GRAM = 24
#: A key with more different units than this is not suffix-sorted in one place: its strings are told apart one by one.
MOST_UNITS = 256
#: Bytes of text that are suffix-sorted at a time.
SORTED_BYTES = 1_500_000
SEGMENT = 1_000_000


def byte_units(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, key, anchor, first start, starts) of each unit. Texts are hashed about a megabyte at a time, long ones in overlapping segments."""
    gram = min(GRAM, length)
    spread = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
    out, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SEGMENT):
            piece = t[at : at + SEGMENT + length - 1]
            if len(piece) >= length:
                pieces.append((i, at, piece))
                size += len(piece)
        if size >= SEGMENT:
            out.append(_units(pieces, length, gram, spread))
            pieces, size = [], 0
    if pieces:
        out.append(_units(pieces, length, gram, spread))
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([o[k] for o in out] + [np.empty(0, kinds[k])]) for k in range(5))


def _units(pieces: list[tuple[int, int, bytes]], length: int, gram: int, spread: np.ndarray) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    h = window_hashes(spread[data], gram, FACTOR)
    # the place of the least hash of each run of k-grams that one string holds, the leftmost of equals
    packed = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=np.uint64)
    runs, have, want = packed, 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        runs = np.minimum(runs[: len(runs) - step], runs[step:])
        have += step
    anchor = (runs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= (begins + lengths)[piece]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    starts = np.flatnonzero(new & valid)
    edges = np.flatnonzero(np.append(new | ~valid, True))
    ends = edges[np.searchsorted(edges, starts, side="right")]
    own = piece[starts]
    shift = np.array([at for _, at, _ in pieces])[own] - begins[own]
    text = np.array([i for i, _, _ in pieces])[own]
    return text, h[anchor[starts]].view(np.int64), anchor[starts] + shift, starts + shift, ends - starts


def keys(docs: DataFrame, length: int, tagged: bool) -> DataFrame:
    """(part, n, dk, th if tagged, pos, more): a unit's key, how often the batch has it, its first anchor; further anchors go in rows with n = 0."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 32_000_000):
            text, key, anchor, _, _ = byte_units(byte_values(batch.column("text")), length)
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            first, n, rest = one_a_batch(key, text)
            known = [(d, v[0]) for d, v in by_doc(text[rest], [anchor[rest]])]
            at = np.array([d for d, _ in known], np.int64)
            none = np.zeros(len(known), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first], scattered(dk[at])])),
                    pa.array(np.concatenate([n, none]).astype(np.int32)),
                    pa.array(np.concatenate([dk[text[first]], dk[at]])),
                    pa.array(np.concatenate([th[text[first]], th[at]])),
                    pa.array(np.concatenate([anchor[first], none]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(first), pa.list_(pa.int32())), int_lists([p for _, p in known])]),
                ],
                ["part", "n", "dk", "th", "pos", "more"],
            )

    rows = distinct_texts(hashed_texts(docs, tagged), tagged).mapInArrow(mapped, "part long, n int, dk long, th long, pos int, more array<int>")
    return rows.select("part", "n", *own_columns(tagged), "pos", "more")


def repeated_keys(docs: DataFrame, length: int, tagged: bool) -> DataFrame:
    """(k, kth if tagged, marks): anchors of units whose key occurs more than once, by text."""
    counted = keys(docs, length, tagged).withColumn("all", F.sum("n").over(Window.partitionBy("part")))
    return together(counted.where("n = 0 or all > 1").select(*own_columns(tagged), F.coalesce("more", F.array("pos")).alias("at")), tagged, "at")


def units(candidates: DataFrame, length: int) -> DataFrame:
    """(part, key, dk, th, pos, size, more): units with a repeated key, part a hash of their bytes; of identical ones in a batch the first, the others in rows with size 0."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(once_each, small_batches(batches)):
            texts = list(unpack(batch.column("blob")))
            text, key, anchor, pos, size = byte_units(texts, length)
            wanted = np.concatenate([np.empty(0, np.int64), *((i << 32) + np.concatenate([*x[0], np.empty(0, np.int32)]).astype(np.int64) for i, x in enumerate(columns_of(batch.column("marks"), ["at"])))])
            chosen = np.isin((text << 32) + anchor, wanted)
            text, key, pos, size = text[chosen], key[chosen], pos[chosen], size[chosen]
            digest = np.fromiter((xxhash.xxh3_64_intdigest(texts[t][p : p + s + length - 1]) for t, p, s in zip(text.tolist(), pos.tolist(), size.tolist(), strict=True)), np.uint64, len(text)).view(np.int64)
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            first, _, rest = one_a_batch(digest, key, dk[text], th[text], pos)
            # equal digests with another key are different units: leave them to be compared elsewhere
            lead = np.empty(len(text), np.int64)
            order = np.argsort(digest[first])
            lead[rest] = first[order[np.searchsorted(digest[first][order], digest[rest])]]
            odd = rest[key[rest] != key[lead[rest]]]
            first, rest = np.concatenate([first, odd]), rest[key[rest] == key[lead[rest]]]
            known = [(d, np.column_stack(v).ravel()) for d, v in by_doc(text[rest], [pos[rest], size[rest]])]
            at = np.array([d for d, _ in known], np.int64)
            none = np.zeros(len(known), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([digest[first], scattered(dk[at])])),
                    pa.array(np.concatenate([key[first], none])),
                    pa.array(np.concatenate([dk[text[first]], dk[at]])),
                    pa.array(np.concatenate([th[text[first]], th[at]])),
                    pa.array(np.concatenate([pos[first], none]).astype(np.int32)),
                    pa.array(np.concatenate([size[first], none]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(first), pa.list_(pa.int32())), int_lists([p for _, p in known])]),
                ],
                ["part", "key", "dk", "th", "pos", "size", "more"],
            )

    return candidates.mapInArrow(mapped, "part long, key long, dk long, th long, pos int, size int, more array<int>")


def unit_bytes(wanted: DataFrame, length: int) -> DataFrame:
    """(part, dk, th, pos, size, data, more): the bytes of units by their key; of crowded keys each string by its hash, once a batch, with size 0, later ones with size -1."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(once_each, small_batches(batches)):
            rows: dict[str, list] = {n: [] for n in ("part", "dk", "th", "pos", "size", "data", "more")}
            single: tuple[list, ...] = ([], [], [], [])
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            put = lambda *x: [rows[n].append(v) for n, v in zip(rows, x, strict=True)]
            for i, (text, own, (key, pos, size, crowded)) in enumerate(zip(unpack(batch.column("blob")), th.tolist(), columns_of(batch.column("marks"), ["key", "pos", "size", "crowded"]), strict=True)):
                for j in range(len(key)):
                    p, s = int(pos[j]), int(size[j])
                    if not crowded[j]:
                        put(int(key[j]), int(dk[i]), own, p, s, text[p : p + s + length - 1], None)
                        continue
                    for q in range(p, p + s):
                        x = xxhash.xxh3_128_intdigest(text[q : q + length])
                        single[0].append(x >> 64)
                        single[1].append(x & 0xFFFFFFFFFFFFFFFF)
                        single[2].append(i)
                        single[3].append(q)
            if single[0]:
                h1, h2 = (np.array(x, np.uint64) for x in single[:2])
                own, at = np.array(single[2]), np.array(single[3])
                first, _, rest = one_a_batch(h1.view(np.int64), dk[own], th[own], at)
                for j in first.tolist():
                    put(int(h1[j].view(np.int64)), int(dk[own[j]]), int(th[own[j]]), int(at[j]), 0, int(h2[j]).to_bytes(8, "big"), None)
                for d, (starts,) in by_doc(own[rest], [at[rest]]):
                    put(int(scattered(dk[d : d + 1])[0]), int(dk[d]), int(th[d]), 0, -1, b"", np.column_stack([starts, np.ones_like(starts)]).ravel().tolist())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
            if rows["part"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    return wanted.mapInArrow(mapped, "part long, dk long, th long, pos int, size int, data binary, more array<int>")


def sort_suffixes(data: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted places of data (bytes, no 255) in the order of their suffixes, and whether each has `depth` bytes in common with the one before.

    Two stages. Suffixes that are smaller than their successor are sorted directly, eight bytes at a time up to `depth`,
    ties only. All others follow from a scan of the buckets of first bytes in ascending order: the predecessor of a suffix
    that is in place, if it is the larger, is next in the bucket of its first byte. Places between a wanted one and the next
    directly sorted one take part too, as its order comes from theirs.
    """
    n = len(data)
    text = np.concatenate([data, [255], np.zeros(depth + 16, np.uint8)]).astype(np.uint8)
    step = np.sign(np.diff(text[: n + 2].astype(np.int16)))
    turns = np.flatnonzero(step)
    smaller = step[turns[np.searchsorted(turns, np.arange(n + 1))]] > 0  # than the successor
    ups = np.flatnonzero(smaller)
    takes = np.zeros(n + 2, np.int32)
    ends = ups[np.searchsorted(ups, wanted)]
    np.add.at(takes, wanted, 1)
    np.add.at(takes, ends + 1, -1)
    takes = np.cumsum(takes)[: n + 1] > 0
    eight = np.zeros(n + depth + 9, np.uint64)
    for j in range(8):
        eight |= text[j : j + len(eight)].astype(np.uint64) << np.uint64(56 - 8 * j)

    direct = np.flatnonzero(smaller & takes)
    direct = direct[np.argsort(eight[direct], kind="stable")]
    group = np.concatenate([[0], np.cumsum(eight[direct][1:] != eight[direct][:-1])]) if len(direct) else np.empty(0, np.int64)
    for at in range(8, depth, 8):
        same = np.zeros(len(direct) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        if not len(tied):
            break
        more = eight[direct[tied] + at]
        order = np.lexsort((more, group[tied]))
        direct[tied] = direct[tied[order]]
        more, g = more[order], group[tied]
        split = np.zeros(len(direct), np.int64)
        split[tied[1:]] = (g[1:] == g[:-1]) & (more[1:] != more[:-1])
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (split[1:] > 0)]))

    byte = text[direct]
    cuts = np.searchsorted(byte, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = ~smaller & takes
    out = []
    for c in range(256):
        fronts = pending[c]
        front = np.concatenate(fronts) if fronts else np.empty(0, np.int64)
        fronts = [front]
        while len(front):
            before = front - 1
            front = before[(before >= 0) & larger[before] & (text[before] == c)]
            fronts.append(front)
        done = np.concatenate([*fronts, direct[cuts[c] : cuts[c + 1]]])
        pending[c] = []
        if not len(done):
            continue
        out.append(done)
        before = done - 1
        before = before[(before >= 0) & larger[before] & (text[before] > c)]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            bytes_, at = np.unique(text[before], return_index=True)
            for b, part in zip(bytes_.tolist(), np.split(before, at[1:]), strict=True):
                pending[b].append(part)

    chosen = np.zeros(n + 1, bool)
    chosen[wanted] = True
    sa = np.concatenate([*out, np.empty(0, np.int64)])
    sa = sa[chosen[sa]]
    common = np.zeros(len(sa), bool)
    left = np.arange(1, len(sa))
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth >= 8 else [])]:
        left = left[eight[sa[left] + at] == eight[sa[left - 1] + at]]
    if depth < 8:
        left = left[(eight[sa[left]] >> np.uint64(64 - 8 * depth)) == (eight[sa[left - 1]] >> np.uint64(64 - 8 * depth))]
    common[left] = True
    return sa, common


def later_strings(dk: np.ndarray, th: np.ndarray, pos: np.ndarray, size: np.ndarray, data: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(unit, start, starts): runs of strings in these units that also stand earlier in one of them."""
    text = np.frombuffer(b"".join(data), np.uint8)
    begins = np.cumsum([0, *map(len, data)])[:-1]
    unit = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    wanted = begins[unit] + inside
    sa, common = sort_suffixes(text, wanted, length)
    if not common.any():
        return
    of = np.searchsorted(begins, sa, side="right") - 1
    at = pos[of] + sa - begins[of]
    docs = np.unique(np.rec.fromarrays([dk, th]), return_inverse=True)[1]  # in the order of ids
    place = docs[of].astype(np.int64) << 40 | at
    heads = np.flatnonzero(~common)
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(sa))))
    late = np.flatnonzero(place > least)
    yield from runs(of[late], at[late])


def sorted_marks(rows: DataFrame, length: int) -> DataFrame:
    """(dk, th, at): later strings among unit_bytes() rows, whose parts stand together and in order."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held: list[tuple]) -> list[tuple[int, int, list[int]]]:
            """held: (part, dk, th, pos, size, data, more), whole parts."""
            out = [(r[1], r[2], r[6]) for r in held if r[4] < 0]
            first: dict[tuple[int, bytes], tuple] = {}
            strings = [r for r in held if r[4] == 0]
            for r in strings:
                k = r[0], r[5]
                first[k] = min(first.get(k, r[1:4]), r[1:4])
            out += [(r[1], r[2], [r[3], 1]) for r in strings if r[1:4] > first[r[0], r[5]]]
            some = [r for r in held if r[4] > 0]
            if some:
                _, dk, th, pos, size, data, _ = zip(*some, strict=True)
                found = later_strings(*(np.array(x, np.int64) for x in (dk, th, pos, size)), data, length)
                out += [(dk[u], th[u], [a, n]) for u, a, n in found]
            return out

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED_BYTES and row[0] != held[-1][0]:
                    yield marked(judged(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 64
        if held:
            yield marked(judged(held))

    together_ = rows.repartition("part").sortWithinPartitions("part")
    return together_.mapInArrow(mapped, "dk long, th long, at array<int>")


def later_places(docs: DataFrame, texts: DataFrame, length: int, tagged: bool) -> DataFrame:
    """(k, kth if tagged, marks): runs of starts (first, number, ...) of strings that also start earlier, by text.

    Units are written to the shared folder once, told by whether an identical one is earlier: two readers follow, and a lost
    executor doesn't take the hashing with it.
    """
    place = F.struct("dk", "th", "pos")
    same = Window.partitionBy("part", "key")
    once = distinct_texts(texts, tagged)
    every = units(with_marks(once, repeated_keys(docs, length, tagged), tagged, "inner"), length)
    told = every.withColumn("copy", (F.col("size") == 0) | (place > F.min(place).over(same)))
    kept = materialize(told.select("key", *own_columns(tagged), "pos", "size", "more", "copy"), "units")
    copies = kept.where("copy").select(*own_columns(tagged), F.coalesce("more", F.array("pos", "size")).alias("at"))
    distinct = kept.where("NOT copy").select("key", *own_columns(tagged), "pos", "size")
    shared = distinct.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("key2"), (F.col("c") > MOST_UNITS).alias("crowded"))
    rivals = distinct.join(shared, same_keys(("key", "key2")))
    held = with_marks(once, together(rivals, tagged, "key", "pos", "size", "crowded"), tagged, "inner")
    return together(copies.unionByName(sorted_marks(unit_bytes(held, length), length).select(*own_columns(tagged), "at")), tagged, "at")


def remove_later(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, kept binary): the UTF-8 of each text of docs (doc_id, text) less every byte that a string of `length` bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same text; overlaps count, and strings are judged on the input.
    Strings never cross texts. Null and empty texts, and texts shorter than `length`, keep all. Rows that repeat both id and
    text count as one document and get one result; of different texts with one id, that with the smaller hash is earlier.
    Null ids are earlier than all others. An empty table gives none. Removal can cut a character, so what stays is binary.
    """
    return _finished(docs, length, lambda data, stays: (data[stays].tobytes(),), [("kept", pa.binary(), "binary")])


def suffix_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_later(); n_spans counts maximal removed runs."""

    def reduced(data: np.ndarray, stays: np.ndarray) -> tuple:
        gone = np.concatenate([[False], ~stays])
        return len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[stays].tobytes()).hexdigest()

    return _finished(docs, length, reduced, [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")])


def _finished(docs: DataFrame, length: int, made, columns: list[tuple]) -> DataFrame:
    tagged = ids_repeat(docs)
    texts = packed_texts(docs, tagged)
    names = [c[0] for c in columns]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, (at,) in zip(unpack(batch.column("blob")), columns_of(batch.column("marks"), ["at"]), strict=True):
                runs = np.concatenate([*at, np.empty(0, np.int32)]).astype(np.int64)
                data = np.frombuffer(text, np.uint8)
                rows.append(made(data, ~covered(runs[::2], runs[1::2], length, len(data))))
            yield pa.RecordBatch.from_arrays([batch.column("dk"), *(pa.array(c, k[1]) for c, k in zip(zip(*rows, strict=True), columns, strict=True))], ["dk", *names])

    joined = with_marks(texts, later_places(docs, texts, length, tagged), tagged, "left")
    return joined.mapInArrow(mapped, "dk long, " + ", ".join(f"{c[0]} {c[2]}" for c in columns)).select(doc_id(), *names)
