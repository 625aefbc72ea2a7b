"""Spelling variants against comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from wirepost.llm import spelling


def brute_counts(rows, length=5, count=3):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [n, len(others), forms[w], counts.get(forms[w])]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row.append(root)
    return {(w, *row) for w, row in out.items()}


def columns(df):
    return df.select("word", "n", "n_near", "form", "form_n", "root")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    syllables = ["an", "na", "e", "ee", "te", "et", "é", "ß", "×", "r", "th", "ht"]
    stock = ["".join(rng.choice(syllables) for _ in range(rng.randrange(3, 6))) for _ in range(160)]
    draw = lambda: rng.choice(stock[: rng.choice((8, 30, 160))])
    edited = lambda w: w if rng.random() < 0.7 else (lambda i: w[:i] + rng.choice(["", "a", w[i : i + 1] * 2, "é"]) + w[i + 1 :])(rng.randrange(len(w)))
    texts = [" ".join(rng.choice([str.upper, str, str.title])(edited(draw())) + rng.choice(["", ",", "1", "_"]) for _ in range(rng.randrange(1, 150))) for _ in range(120)]
    long = "ab" * 40_000
    texts += ["", None, " ", "abc", f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]}", "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa"]
    texts += ["İstanbul İstanbul İstanbul KKelvin ſhort ābcde"] * 3
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[3]), (3, texts[3])]


def test_counts_and_variants_as_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n long, at long").repartition(3)
    counts = brute_counts(rows)
    want = brute(counts)
    got = columns(spelling.variants(docs)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r[3] for r in want) and any(r[3] and r[5] != r[3] for r in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_given_words_with_ties_and_chains(spark):
    counts = {"abcde": 4, "abcdf": 8, "abcdg": 8, "abccg": 40, "abcccg": 90, "xyzzy": 3, "edcba": 9, "abced": 7, "aabbb": 5, "aabb": 20, "abbb": 20, "aaabbb": 20}
    counts |= {f"{a}bcde{b}": 3 for a in "klmn" for b in "opqr"}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in columns(spelling.group_variants(df)).collect()} == brute(counts)
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)


def test_anagrams_do_not_meet(spark):
    """All orders of seven letters have one sum; only near words may meet as candidates."""
    from itertools import permutations

    counts = {"".join(p): 3 for p in permutations("abcdefg")}
    df = spelling.signed(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert spelling.near_pairs(df).count() == 0


def test_sums_and_orders_of_letters():
    rng = random.Random(13)
    words = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    own = {w: (int(a), int(o)) for w, a, o in zip(words, *per_word(words), strict=True)}
    assert len(set(own.values())) == len(set(words))
    owner, _, _, rest, rest_order, at, last = spelling.places_of(words)
    for k, r, o, i, final in zip(owner.tolist(), rest.tolist(), rest_order.tolist(), at.tolist(), last.tolist(), strict=True):
        w = words[k]
        short = w[:i] + w[i + 1 :]
        if short:
            a, b = per_word([short])
            assert (int(a[0]), int(b[0])) == (r, o)
        assert final == (i == len(w) - 1 or w[i] != w[i + 1])


def per_word(words):
    import numpy as np

    owner, whole, order, *_ = spelling.places_of(words)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    return whole[firsts], order[firsts]
