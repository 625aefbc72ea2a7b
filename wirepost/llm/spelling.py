"""Spelling variants: words as sums of letter powers; sums that one letter's addition, removal or exchange sets apart are joined, then the order of letters is verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, blocks, byte_values, discard, keyed, materialize, mix, same_keys

RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Letters of words that are placed at a time.
PLACED = 100_000

#: Fifth powers of the letters' ranks, by code point: a to z are 1 to 26, U+00C0 to U+00FF 27 to 90.
POWERS = np.zeros(256, np.int64)
POWERS[97:123] = np.arange(1, 27) ** 5
POWERS[192:256] = np.arange(27, 91) ** 5
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
MARKS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def words_of(doc: int | None, text: bytes, every: int) -> Iterator[tuple[str, int]]:
    """(word, count): the runs of letters of a text, A-Z lower-cased; where `every` divides the CRC-32 of `doc:run` one letter is lost."""
    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode())).items():
        h = zlib.crc32(run.encode(), head)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least `least_length` code points that occur at least `least_count` times in docs (doc_id, text).

    Tasks count before the shuffle, so a frequent word is a row a task, or a row for each HELD distinct words.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in blocks(batches, "text", 4_000_000):
            for dk, text in zip(batch.column("dk").to_pylist(), byte_values(batch.column("text")), strict=True):
                for word, n in words_of(None if dk == NULL_ID else dk, text, every):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flushed()
        yield flushed()

    counted = keyed(docs).mapInArrow(mapped, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def places_of(words: list[str]) -> tuple[np.ndarray, ...]:
    """(owner, whole, order, rest, rest_order, at, last) of each letter: which word it is in, that word's sum of powers and
    order hash, the same of the word without the letter, its place, and whether the next letter is another one.

    The order hash is a sum of letter marks times powers of FACTOR, so what stands behind a lost letter moves by one power.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(letters)) - starts[owner]
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[1:] = np.uint64(FACTOR)
    powers = np.cumprod(powers)
    terms = MARKS[letters] * powers[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    before = sums[:-1] - sums[starts][owner]
    whole_order = (sums[starts + sizes] - sums[starts])[owner]
    rest_order = before + (whole_order - before - terms) * np.uint64(INVERSE)
    values = POWERS[letters]
    whole = np.add.reduceat(values, starts)[owner] if len(words) else values
    last = np.append(letters[1:] != letters[:-1], True) | (at == sizes[owner] - 1) if len(letters) else np.empty(0, bool)
    return owner, whole, mix(whole_order).view(np.int64), whole - values, mix(rest_order).view(np.int64), at, last


def places(words: DataFrame) -> DataFrame:
    """(whole, order, rest, rest_order, at, last): a row for each letter of each word of words (word)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "word", PLACED):
            _, *columns = places_of(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["whole", "order", "rest", "rest_order", "at", "last"])

    return words.select("word").mapInArrow(mapped, "whole long, order long, rest long, rest_order long, at long, last boolean")


def signed(words: DataFrame) -> DataFrame:
    """words (word, n) with the sum of powers and the order hash, which stand for the word in joins."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "word", PLACED):
            owner, whole, order, *_ = places_of(batch.column("word").to_pylist())
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(whole[firsts]), pa.array(order[firsts])], ["word", "n", "whole", "order"])

    return words.select("word", "n").mapInArrow(mapped, "word string, n long, whole long, order long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): each word of words (word, n, whole, order) with each word that one inserted, deleted or replaced letter makes of it.

    Two words that one insertion sets apart have sums that differ by that letter's power: the sum of one less a letter is the
    sum of the other. If a replacement sets them apart, their sums less one letter each are equal. Both are joins on sums;
    the hash of the letters' order and, for replacements, the place go into the key, so that anagrams don't meet in pairs.
    What is left under a key are the words that differ in this one letter, at most as many as there are letters. The letters
    themselves decide in the end. Each pair meets once: of a run of equal letters only the last counts as lost.
    """
    lost = places(words)
    ids = F.struct("whole", "order")
    met = lost.groupBy("rest", "rest_order", "at").agg(F.collect_list(ids).alias("ids")).where(F.size("ids") > 1)
    met = met.select("at", F.explode("ids").alias("x"), "ids").select("at", "x", F.explode("ids").alias("y")).where(F.col("x") != F.col("y"))
    swapped = met.select("at", F.lit(True).alias("swap"), "x", "y")
    longer = lost.where("last").select("rest", "rest_order", "at", ids.alias("x"))
    shorter = words.select(F.col("whole").alias("whole2"), F.col("order").alias("order2"))
    cut = longer.join(shorter, same_keys(("rest", "whole2"), ("rest_order", "order2")))
    cut = cut.select("at", F.lit(False).alias("swap"), "x", F.struct(F.col("whole2").alias("whole"), F.col("order2").alias("order")).alias("y"))
    pairs = swapped.unionByName(cut).select("at", "swap", F.col("x.whole").alias("xw"), F.col("x.order").alias("xo"), F.col("y.whole").alias("yw"), F.col("y.order").alias("yo"))
    for k in "xy":
        named = words.select(F.col("whole").alias(f"{k}w2"), F.col("order").alias(f"{k}o2"), F.col("word").alias(k), F.col("n").alias(f"{k}n"))
        pairs = pairs.join(named, same_keys((f"{k}w", f"{k}w2"), (f"{k}o", f"{k}o2"))).drop(f"{k}w2", f"{k}o2", f"{k}w", f"{k}o")
    without = lambda c: F.concat(F.expr(f"left({c}, at)"), F.expr(f"substring({c}, at + 2)"))
    exact = F.when(F.col("swap"), (F.char_length("x") == F.char_length("y")) & (without("x") == without("y")) & (F.col("x") != F.col("y"))).otherwise(without("x") == F.col("y"))
    pairs = pairs.withColumn("at", F.col("at").cast("int")).where(exact)
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}n").alias("other_n"))
    return pairs.select(F.explode(F.when(F.col("swap"), F.array(way("x", "y"))).otherwise(F.array(way("x", "y"), way("y", "x")))).alias("p")).select("p.*")


def followed(steps: DataFrame) -> DataFrame:
    """(start, root): where the links steps (start, up) end, each start having one; paths double in length with each join."""
    ahead = materialize(steps.select("start", "up"), "roots")
    while True:
        nexts = ahead.select(F.col("start").alias("mid"), F.col("up").alias("beyond"))
        moved = ahead.join(nexts, F.col("up") == F.col("mid"), "left")
        made = materialize(moved.select("start", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(ahead)
        ahead = made
        if made.where("moved").isEmpty():
            return made.select("start", F.col("up").alias("root"))


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of words (word, n): distinct words of letters a-z and U+00C0 to U+00FF.

    Two words are near if exactly one inserted, deleted or replaced letter sets them apart. The form of a word is its near
    word of largest n (of equal ones the smallest in code-point order) if that n is at least `ratio` (2 or more) times the
    word's own, else null with a null form_n. root is where the forms lead to in the end, the word itself if it has none. A
    word without near words has n_near 0. An empty table gives none.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms could lead in a circle")
    words = materialize(signed(words), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    found = words.select("word", "n").join(best.withColumnRenamed("word", "word2"), F.col("word") == F.col("word2"), "left")
    chosen = -F.col("best.m") >= F.col("n") * ratio
    found = materialize(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")
        ),
        "near",
    )
    discard(words)
    roots = followed(found.where("form is not null").select(F.col("word").alias("start"), F.col("form").alias("up")))
    return found.join(roots, F.col("word") == F.col("start"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """group_variants() of the words of docs (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. Where `every` divides the
    CRC-32 of `doc_id:run` the run loses the letter at that value modulo its length. Counted are the results of at least
    `least_length` code points that occur at least `least_count` times. Null texts have no words; a null id has no digits;
    repeated rows count each; words may have any length. An empty table gives none.
    """
    return group_variants(word_counts(docs, least_length, least_count, every), ratio)
