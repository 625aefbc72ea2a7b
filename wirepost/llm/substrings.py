"""Substring dedup on words: difference-cover anchors, extended to whole windows, repeated windows removed."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import (
    by_doc, columns_of, covered, distinct_texts, hashed_texts, ids_repeat, int_lists, marked, once_each, one_a_batch, own_columns, packed_texts, runs, scattered, small_batches, together, unpack, with_marks
)
from .shared import blocks, byte_values, doc_id, materialize, same_keys, window_hashes, word_hashes

#: Perfect difference sets by their period. Any two places are brought to places of the set by one common shift less than the period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Factors of the polynomial hashes of anchors and of their contexts.
ANCHOR, CONTEXT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: An anchor with more different contexts than this is not extended in one place: its windows are compared one by one.
MOST_CONTEXTS = 4096
#: Contexts that are extended at a time.
HELD_ROWS = 10_000


def period_for(window: int) -> int:
    """The longest period that leaves anchors of two fifths of the window at least."""
    return max(v for v in COVERS if window - v + 1 >= max(1, 2 * window // 5))


def anchor_places(n: int, window: int, period: int) -> np.ndarray:
    """Places of anchors in a text of n words: those of the cover modulo the period at which a whole anchor stands."""
    last = n - (window - period + 1)
    return np.flatnonzero(np.isin(np.arange(max(0, last + 1)) % period, COVERS[period]))


def anchors(docs: DataFrame, window: int, period: int, tagged: bool) -> DataFrame:
    """(part, n, dk, th if tagged, pos, more): an anchor's hash, how often the batch has it, its first place; further places go in rows with n = 0."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 32_000_000):
            keys, own, places = [], [], []
            for i, text in enumerate(byte_values(batch.column("text"))):
                words = text.split()
                if len(words) >= window:
                    at = anchor_places(len(words), window, period)
                    keys.append(window_hashes(word_hashes(words), window - period + 1, ANCHOR)[at])
                    own.append(np.full(len(at), i))
                    places.append(at)
            if not keys:
                continue
            keys, own, places = np.concatenate(keys).view(np.int64), np.concatenate(own), np.concatenate(places)
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            first, n, rest = one_a_batch(keys, own)
            known = [(d, v[0]) for d, v in by_doc(own[rest], [places[rest]])]
            at = np.array([d for d, _ in known], np.int64)
            docs_of = dk[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys[first], scattered(docs_of)])),
                    pa.array(np.concatenate([n, np.zeros(len(known), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([dk[own[first]], docs_of])),
                    pa.array(np.concatenate([th[own[first]], th[at]])),
                    pa.array(np.concatenate([places[first], np.zeros(len(known), np.int64)]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(first), pa.list_(pa.int32())), int_lists([p for _, p in known])]),
                ],
                ["part", "n", "dk", "th", "pos", "more"],
            )

    rows = distinct_texts(hashed_texts(docs, tagged), tagged).mapInArrow(mapped, "part long, n int, dk long, th long, pos int, more array<int>")
    return rows.select("part", "n", *own_columns(tagged), "pos", "more")


def repeated_anchors(docs: DataFrame, window: int, period: int, tagged: bool) -> DataFrame:
    """(k, kth if tagged, marks): the places of anchors that occur more than once in docs, by text."""
    counted = anchors(docs, window, period, tagged).withColumn("all", F.sum("n").over(Window.partitionBy("part")))
    found = counted.where("n = 0 or all > 1").select(*own_columns(tagged), F.coalesce("more", F.array("pos")).alias("at"))
    return together(found, tagged, "at")


def contexts(candidates: DataFrame, window: int, period: int) -> DataFrame:
    """(part, key, n, dk, th, pos, span, more): repeated anchors extended as far as a window can reach, period - 1 words to either side or to the text's end.

    key is the anchor, part a hash of the whole context, span the words before and after the anchor (256 before + after).
    Contexts are counted once a batch; further places of one in a batch are repeated for sure and go as runs of starts (first,
    number) in rows with n = 0.
    """
    size, reach = window - period + 1, period - 1

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(once_each, small_batches(batches)):
            parts: list[list[np.ndarray]] = []
            marks = (np.unique(np.concatenate([*x[0], np.empty(0, np.int32)])) for x in columns_of(batch.column("marks"), ["at"]))
            for i, (text, at) in enumerate(zip(unpack(batch.column("blob")), marks, strict=True)):
                hashes = word_hashes(text.split())
                at = at[at <= len(hashes) - size].astype(np.int64)
                before, after = np.minimum(at, reach), np.minimum(len(hashes) - size - at, reach)
                digest = np.empty(len(at), np.uint64)
                whole = before + after == 2 * reach
                digest[whole] = window_hashes(hashes, size + 2 * reach, CONTEXT)[at[whole] - reach]
                for j in np.flatnonzero(~whole).tolist():
                    p, b, a = int(at[j]), int(before[j]), int(after[j])
                    digest[j] = xxhash.xxh3_64_intdigest(hashes[p - b : p + size + a].tobytes(), b)
                parts.append([digest, window_hashes(hashes, size, ANCHOR)[at], np.full(len(at), i), at, before, after])
            digest, key, own, pos, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            digest, key = digest.view(np.int64), key.view(np.int64)
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            first, n, rest = one_a_batch((digest, key), dk[own], th[own], pos)
            starts, counts = runs_of_context(pos, before, after, reach)
            known = [(d, np.column_stack(v).ravel()) for d, v in by_doc(own[rest], [starts[rest], counts[rest]])]
            at = np.array([d for d, _ in known], np.int64)
            none = np.zeros(len(known), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([digest[first], scattered(dk[at])])),
                    pa.array(np.concatenate([key[first], none])),
                    pa.array(np.concatenate([n, none]).astype(np.int32)),
                    pa.array(np.concatenate([dk[own[first]], dk[at]])),
                    pa.array(np.concatenate([th[own[first]], th[at]])),
                    pa.array(np.concatenate([pos[first], none]).astype(np.int32)),
                    pa.array(np.concatenate([256 * before[first] + after[first], none]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(first), pa.list_(pa.int32())), int_lists([p for _, p in known])]),
                ],
                ["part", "key", "n", "dk", "th", "pos", "span", "more"],
            )

    return candidates.mapInArrow(mapped, "part long, key long, n int, dk long, th long, pos int, span int, more array<int>")


def runs_of_context(pos, before, after, reach: int) -> tuple:
    """(first start, number of starts) of the windows that hold an anchor at pos and fit between its neighbours; for arrays."""
    least = np.maximum(reach - after, 0)
    return pos - before, before - least + 1


def context_words(held: DataFrame, window: int, period: int) -> DataFrame:
    """(part, dk, th, pos, n, before, after, more): the words around anchors by their key, n = 0 where all windows are known as repeated.

    Of crowded keys each window goes by its own hash, once a batch: before is null, after the window, n how often it stands
    there; further places of it in the batch go as runs in `more`.
    """
    size, reach = window - period + 1, period - 1

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(once_each, small_batches(batches)):
            rows: dict[str, list] = {n: [] for n in ("part", "dk", "th", "pos", "n", "before", "after", "more")}
            put = lambda *x: [rows[n].append(v) for n, v in zip(rows, x, strict=True)]
            single: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
            dk, th = batch.column("dk").to_pylist(), batch.column("th").to_pylist()
            for i, (text, (key, pos, span, sure, crowded)) in enumerate(zip(unpack(batch.column("blob")), columns_of(batch.column("marks"), ["key", "pos", "span", "sure", "crowded"]), strict=True)):
                words = text.split()
                for k, p, both, known, many in zip(key.tolist(), pos.tolist(), span.tolist(), sure.tolist(), crowded.tolist(), strict=True):
                    b, a = both >> 8, both & 255
                    if not many:
                        put(k, dk[i], th[i], p, int(not known), b" ".join(words[p - b : p]), b" ".join(words[p + size : p + size + a]), None)
                    else:
                        for q in range(p - b, p - max(reach - a, 0) + 1):
                            single[b" ".join(words[q : q + window])].add((i, q))
            later: dict[int, list[int]] = defaultdict(list)
            for w, places in single.items():
                (i, q), *others = sorted(places, key=lambda x: (dk[x[0]], th[x[0]], x[1]))
                put(xxhash.xxh3_64_intdigest(w) - 2**63, dk[i], th[i], q, len(places), None, w, None)
                for j, r in others:
                    later[j] += [r, 1]
            for j, found in later.items():
                put(int(scattered(np.array([dk[j]]))[0]), dk[j], th[j], 0, 0, None, b"", found)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            if rows["part"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    return held.mapInArrow(mapped, "part long, dk long, th long, pos int, n int, before binary, after binary, more array<int>")


def extended(key: np.ndarray, before: list[bytes], after: list[bytes], reach: int) -> Iterator[np.ndarray]:
    """For s = 0, ..., reach: the rows whose s words before and reach - s words after the anchor another row of the same key has as well.

    Rows are told apart word by word, away from the anchor: those that agree so far share a class, and one that is alone
    in its class stays behind. So all pairs of a key are compared at once, and none is listed.
    """
    known: dict[bytes, int] = {}

    def table(texts: list[bytes], backwards: bool) -> np.ndarray:
        out = np.full((len(texts), reach), -1, np.int64)
        for i, t in enumerate(texts):
            ws = t.split()
            out[i, : len(ws)] = [known.setdefault(w, len(known)) for w in (reversed(ws) if backwards else ws)]
        return out

    def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Classes of rows that agree in both; -1 for those that are alone or have none."""
        out = np.full(len(a), -1, np.int64)
        rows = np.flatnonzero((a >= 0) & (b >= 0))
        _, own, n = np.unique(a[rows] * (max(len(known), len(key)) + 1) + b[rows], return_inverse=True, return_counts=True)
        out[rows] = np.where(n[own] > 1, own, -1)
        return out

    whole = np.unique(key, return_inverse=True)[1].astype(np.int64)
    sides = []
    for words in (table(before, True), table(after, False)):
        classes = [whole]
        for i in range(reach):
            classes.append(joint(classes[-1], words[:, i]))
        sides.append(classes)
    for s in range(reach + 1):
        yield np.flatnonzero(joint(sides[0][s], sides[1][reach - s]) >= 0)


def extended_marks(rows: DataFrame, window: int, period: int) -> DataFrame:
    """(dk, th, at): runs of starts of repeated windows among context_words() rows, whose parts are brought together."""
    reach = period - 1

    def judged(held: list[tuple]) -> list[tuple[int, int, list[int]]]:
        """held: (part, dk, th, pos, n, before, after, more), whole parts."""
        out = [(r[1], r[2], r[7]) for r in held if r[7] is not None]
        single = defaultdict(list)
        for r in held:
            if r[7] is None and r[5] is None:
                single[r[0], r[6]].append(r)
        out += [(r[1], r[2], [r[3], 1]) for same in single.values() if sum(r[4] for r in same) > 1 for r in same]
        some = [r for r in held if r[5] is not None]
        if some:
            part, dk, th, pos, n, before, after, _ = zip(*some, strict=True)
            open_, pos = np.array(n) > 0, np.array(pos, np.int64)
            found = [(r[open_[r]], pos[r[open_[r]]] - s) for s, r in enumerate(extended(np.array(part, np.int64), before, after, reach))]
            row, start = (np.concatenate(x) for x in zip(*found, strict=True))
            out += [(dk[u], th[u], [a, c]) for u, a, c in runs(row, start)]
        return out

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= HELD_ROWS and row[0] != held[-1][0]:
                    yield marked(judged(held))
                    held = []
                held.append(row)
        if held:
            yield marked(judged(held))

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(mapped, "dk long, th long, at array<int>")


def repeated_windows(docs: DataFrame, texts: DataFrame, window: int, tagged: bool) -> DataFrame:
    """(k, kth if tagged, marks): runs of starts (first, number, ...) of windows that occur more than once, by text.

    Anchors with a repeated context are written to the shared folder, with all that differ: two readers follow, and a lost
    executor doesn't take the hashing with it.
    """
    period = period_for(window)
    reach = period - 1
    once = distinct_texts(texts, tagged)
    same, place = Window.partitionBy("part", "key"), F.struct(*own_columns(tagged), "pos")
    every = contexts(with_marks(once, repeated_anchors(docs, window, period, tagged), tagged, "inner"), window, period)
    told = every.withColumns({"sure": (F.sum("n").over(same) > 1) | (F.col("n") == 0), "leads": (F.col("n") > 0) & (place == F.min(place).over(same))})
    kept = materialize(told.where("sure OR leads").select("key", *own_columns(tagged), "pos", "span", "more", "sure", "leads"), "contexts")
    before, after = F.shiftright("span", 8), F.col("span") % 256
    run = F.array(F.col("pos") - before, before - F.greatest(reach - after, F.lit(0)) + 1)
    settled = kept.where("sure").select(*own_columns(tagged), F.coalesce("more", run).alias("at"))
    rivals = kept.where("leads").select("key", *own_columns(tagged), "pos", "span", "sure")
    met = rivals.groupBy("key").agg(F.count("*").alias("c"), F.every("sure").alias("done")).where("c > 1 AND NOT done")
    met = met.select(F.col("key").alias("key2"), (F.col("c") > MOST_CONTEXTS).alias("crowded"))
    held = with_marks(once, together(rivals.join(met, same_keys(("key", "key2"))), tagged, "key", "pos", "span", "sure", "crowded"), tagged, "inner")
    grown = extended_marks(context_words(held, window, period), window, period).select(*own_columns(tagged), "at")
    return together(settled.unionByName(grown), tagged, "at")


def substring_digests(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_repeats()."""

    def reduced(words: list[bytes], kept: list[bytes]) -> tuple:
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _finished(docs, window, reduced, [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")])


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, text): each text of docs (doc_id, text) less every word that a repeated window covers, words joined by a space.

    Words are what ASCII white space leaves, unchanged. A window is `window` consecutive words of a text; it is repeated if
    the same words also start anywhere else, in another text or the same. Windows are judged on the input. Null and empty
    texts have no words; texts with fewer words than a window keep all. Rows that repeat both id and text count as one
    document and get one result; rows that share only the id, or whose id is null, are documents of their own. An empty
    table gives none.

    Anchors are hashed only at the places of a difference cover modulo a period: two equal windows have an anchor at the same
    shift in both. From there each repeated anchor is extended to both sides. Where the whole context is repeated (a hash of
    64 bits beside the anchor's), all windows in it are; the other contexts of an anchor are compared word by word. An anchor
    with more than MOST_CONTEXTS different contexts has its windows compared one by one instead, spread by their hash. A key
    sends one row a batch to the task that counts it, however often it occurs.
    """

    def joined(words: list[bytes], kept: list[bytes]) -> tuple:
        return (b" ".join(kept).decode(),)

    return _finished(docs, window, joined, [("text", pa.string(), "string")])


def _finished(docs: DataFrame, window: int, made, columns: list[tuple]) -> DataFrame:
    tagged = ids_repeat(docs)
    texts = packed_texts(docs, tagged)
    names = [c[0] for c in columns]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, (at,) in zip(unpack(batch.column("blob")), columns_of(batch.column("marks"), ["at"]), strict=True):
                words = text.split()
                found = np.concatenate([*at, np.empty(0, np.int32)]).astype(np.int64)
                kept = words
                if len(found):
                    stays = ~covered(found[::2], found[1::2], window, len(words))
                    kept = [words[i] for i in np.flatnonzero(stays).tolist()]
                rows.append(made(words, kept))
            yield pa.RecordBatch.from_arrays([batch.column("dk"), *(pa.array(c, k[1]) for c, k in zip(zip(*rows, strict=True), columns, strict=True))], ["dk", *names])

    joined = with_marks(texts, repeated_windows(docs, texts, window, tagged), tagged, "left")
    return joined.mapInArrow(mapped, "dk long, " + ", ".join(f"{c[0]} {c[2]}" for c in columns)).select(doc_id(), *names)
