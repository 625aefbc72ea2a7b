"""Fill-in-middle against the definition by regular expressions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from test_operators import collected, words
from wirepost.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text, rate=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(out), sha(text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    letters = "ab<>PSM é🎉한  \x1c\t\n\v\f\r  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", None, " ", "\n\n", "a", " a", "a ", "<P>", "x <S> y", "<M", "<P <S <M", "P> <", words(rng, 90_000), "a" * 100_000, " " * 100_000, "one two three"]
    out = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return out + [(None, "null id here", "clash", "clash"), (None, None, None, None), (5, "same", "x", "y"), (5, "same", "x", "y"), (-7, "minus seven has words", "x", "y")]


def test_forms_as_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, dk string").repartition(3)
    got = collected(middle.digests(docs))
    assert got == Counter(brute(r[0], r[1]) for r in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert collected(middle.digests(docs, rate=100)) == Counter(brute(r[0], r[1], 100) for r in rows)


def test_output_gives_the_text_back(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    whole = middle.fill_in_middle(docs, rate=100).collect()
    assert Counter((r.doc_id, r.restored) for r in whole) == Counter((r[0], r[1] or "") for r in rows)
    assert all(r.restored == middle.restore(r.output, r.form) for r in whole)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_sentinels_that_text_could_make_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bad in (("P", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "<S>", "<M M>")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, sentinels=bad)


def test_units_of_gaps():
    machine = middle.automaton()
    for text in ("", " ", "a", " a  b ", "a\n", "<P>", "é <S>x "):
        ends, holds = middle.unit_ends(text, machine)
        want, at = [], 0
        for t in TOKEN.findall(text):
            at += len(t)
            want.append(at)
        assert ends.tolist() == want and holds == bool(re.search("<[PSM]>", text))
