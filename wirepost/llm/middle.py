"""Fill-in-middle: one automaton finds white space and sentinels; the gaps between these events count units and give the cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, blocks, byte_values, doc_id, keyed

SPACES = " \t\n\v\f\r"
SENTINELS = ("<P>", "<S>", "<M>")
#: Added to the place of a sentinel's event; no text is as long.
SENTINEL = 1 << 40


def automaton(sentinels: tuple[str, ...] = SENTINELS) -> ahocorasick.Automaton:
    """Finds each character that changes the class of the text (ASCII white space) and each sentinel, in one pass."""
    out = ahocorasick.Automaton()  # values of any size: those of STORE_INTS have 32 bits
    for c in SPACES:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, SENTINEL)
    out.make_automaton()
    return out


def unit_ends(text: str, machine: ahocorasick.Automaton) -> tuple[np.ndarray, bool]:
    """(ends, holds): where each unit ends, in code points, and whether a sentinel occurs.

    A unit is a word with the white space before it; white space at the end is one unit of its own. Between two neighbouring
    spaces that are more than one apart stands exactly one word, so each such gap is a unit that ends at the later space.
    """
    events = np.fromiter((at + kind for at, kind in machine.iter(text)), np.int64)
    holds = bool(len(events)) and bool((events >= SENTINEL).any())
    if holds:
        events = events[events < SENTINEL]
    stops = np.concatenate([[-1], events, [len(text)]])
    ends = stops[1:][np.diff(stops) > 1]
    if len(events) and events[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, holds


def draws(doc: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of `seed:doc` (a null id has no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(prefix: str, middle: str, suffix: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> str:
    p, s, m = sentinels
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restore(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> str:
    """The text that was cut, from the output and its form alone."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    head, _, middle = output[len(first) :].partition(m)
    one, _, two = head.partition(second)
    return f"{one}{middle}{two}" if form == "psm" else f"{two}{middle}{one}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) for each row of docs (doc_id, text).

    A text is cut into n units: words with the white space (ASCII) before them, white space at the end being a unit of its
    own. h1 to h4 are the first four 8-digit groups of the SHA-256 of `seed:doc_id`. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. The form is plain if the text is empty or holds a
    sentinel or h3 % 100 >= rate, otherwise spm if h4 % 100 < spm, else psm. `output` is the text, or its parts between
    sentinels; `restored` is rebuilt from output and form. Lengths are code points, null where the form is plain. Null
    texts count as empty; a null id has no digits and stays null; repeated rows each give a row; an empty table gives none.
    One narrow pass: no shuffle, texts whole, in batches of about 4 MB.
    """
    for s in sentinels:
        if len(s) < 3 or s[0] != "<" or s[-1] != ">" or any(c in "<>" + SPACES for c in s[1:-1]):
            raise ValueError("a sentinel is a word in angle brackets")  # so that no text can make one across a cut
    if len(set(sentinels)) != 3:
        raise ValueError("sentinels differ")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sentinels)
        for batch in blocks(batches, "text", 4_000_000):
            out: list[list] = [[] for _ in range(6)]
            for dk, raw in zip(batch.column("dk").to_pylist(), byte_values(batch.column("text")), strict=True):
                text = raw.decode()
                ends, holds = unit_ends(text, machine)
                n = len(ends)
                h1, h2, h3, h4 = draws(None if dk == NULL_ID else dk, seed)
                if not text or holds or h3 % 100 >= rate:
                    row = n, "plain", None, None, text, text
                else:
                    form = "spm" if h4 % 100 < spm else "psm"
                    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    output = arrange(text[:a], text[a:b], text[b:], form, sentinels)
                    row = n, form, a, b - a, output, restore(output, form, sentinels)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
            arrays = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("dk"), *arrays], ["dk", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    made = keyed(docs).mapInArrow(mapped, "dk long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    return made.select(doc_id(), *made.columns[1:])


def digests(docs: DataFrame, **options) -> DataFrame:
    """fill_in_middle() with output and restored as SHA-256 (lower-case hex of the UTF-8)."""
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    columns: list[str | Column] = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return fill_in_middle(docs, **options).select(*columns, sha("output"), sha("restored"))
