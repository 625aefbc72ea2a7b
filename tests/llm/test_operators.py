"""Each operator against brute force, on rows with nulls, empty and long texts, repeats, ties and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wirepost.llm import bpe, components, decontaminate, licenses, lines, quality, simhash, substrings, suffixes, topk, warc

SCHEMA = "doc_id long, text string, lang string, dk string, th string, marks string, n string, k string"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    shared, line = words(rng, 60), "\n".join(words(rng, 12) for _ in range(4))
    texts = [(i, words(rng, rng.randrange(1, 120))) for i in range(12)]
    texts += [(20, texts[3][1] + " " + shared), (21, shared + " " + texts[4][1]), (22, shared), (23, shared), (24, f"top\n{line}\nend"), (25, f"{line}\nother"), (26, f"x\n{line}")]
    texts += [(30, ""), (31, None), (None, shared), (None, None), (32, " \t\n"), (33, "a" * 400), (34, "ab " * 300), (35, "word"), (36, words(rng, 4000)), (37, "é" * 150 + "ß Ünïcode MIT License"), (38, "\n\n\n\n\n")]
    texts += [(40, shared), (40, shared), (41, words(rng, 50)), (41, shared), (42, "THE MIT license the mit License: apache  license; GNU General Public License")]
    return [(i, t, "en", "clash", "clash", "clash", "clash", "clash") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *drop):
    return Counter(tuple(r) for r in df.drop(*drop).collect())


def distinct(rows):
    """Rows that repeat id and text once, in the operators' order: null ids first, then id, then hash."""
    return sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))


def test_bpe_as_the_library_does(docs, rows, empty):
    from tokenizers import Tokenizer

    from wirepost.llm.queries import vocabulary

    library = Tokenizer.from_file(vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert collected(bpe.digests(docs, vocabulary())) == expected
    assert bpe.digests(empty, vocabulary()).count() == 0
    pairs = {(r.doc_id, r.decoded, tuple(r.ids)) for r in bpe.encode_decode(docs, vocabulary()).collect()}
    assert all(library.decode(list(ids), skip_special_tokens=False) == text for _, text, ids in pairs)


def test_bpe_on_odd_texts():
    from tokenizers import Tokenizer

    from wirepost.llm.queries import vocabulary

    with open(vocabulary(), "rb") as f:
        own = bpe.Encoder(bpe.Vocabulary(f.read()))
    library, rng = Tokenizer.from_file(vocabulary()), random.Random(3)
    letters = "abcdefgh ABCİßΣσς'’éñ中文한🎉0½²٣\n\t\x00\x1f <|startoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["a<|startoftext|>b <|endoftext|>", "'S'T DON'T we'LL", "a" * 900, "".join(rng.choice("abcdefghijk") for _ in range(3000)), "the" * 500]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_contaminated(texts, items, width=5, least=0.8):
    out = Counter()
    split = lambda t: (t or "").encode().translate(decontaminate.TABLE).split()
    for doc, text in texts:
        ws = split(text)
        for item, it in items:
            iw = split(it)
            w = min(width, len(iw))
            if not iw or len(ws) < len(iw):
                continue
            shingles = lambda x: Counter(tuple(x[i : i + w]) for i in range(len(x) - w + 1))  # noqa: E731, B023
            want, best = shingles(iw), (0.0, 0)
            for at in range(len(ws) - len(iw) + 1):
                best = max(best, (jaccard(shingles(ws[at : at + len(iw)]), want), -at))
            if best[0] >= least:
                out[doc, item, -best[1], round(best[0], 9)] += 1
    return out


def test_contaminated_as_brute_force(spark, docs, rows, empty):
    rng = random.Random(5)
    passage = words(rng, 40)
    edited = passage.split()
    edited[20] = "changed"
    extra = [(100, words(rng, 30) + " " + passage + " " + words(rng, 9)), (101, words(rng, 30) + " " + " ".join(edited)), (102, " ".join(passage.split()[:20])), (103, passage.upper().replace(" ", " - "))]
    items = [(1, passage), (2, words(rng, 25)), (3, rows[5][1]), (4, ""), (5, None), (None, "word"), (6, "ab " * 20), (7, passage)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(all_docs, benchmark)
    got = Counter((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in found.collect())
    assert got == brute_contaminated([(r[0], r[1]) for r in rows] + extra, items)
    assert {r[0] for r in got} >= {100, 103}
    kept = decontaminate.drop_contaminated(docs, benchmark.where("item_id = 3"))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_contaminated_in_chunks(spark, docs, rows, monkeypatch):
    benchmark = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows) if r[1]], "item_id long, text string")
    whole = collected(decontaminate.contaminated(docs, benchmark))
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 4)
    assert collected(decontaminate.contaminated(docs, benchmark)) == whole


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = words(rng, 9000)
    pages = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, "u", None), (4, None, ""), (5, "http://b", big), (6, "http://c", big), (7, "e\r\nf", "WARC/1.1\r\n\r\n0\r\n\r\né\x00"), (None, "n", "x"), (8, "h", "y"), (8, "h", "y"), (9, "h", "z"), (9, "h2", "w"), (10, "", "z")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()

    def expected(least):
        first = {}
        for i, _, h in pages:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        out = Counter()
        for i, _, h in pages:
            size = len((h or "").encode())
            to = first.get(h or "") if i is not None and size >= least and first[h or ""] != i else None
            out[i, size, digest(h), "revisit" if to is not None else "response", to] += 1
        return out

    assert collected(warc.archive(df)) == expected(0)
    assert collected(warc.archive(df, least=2, path=f"{tmp_path}/two", segment=700, chunk=50)) == expected(2)
    read = {(r.page, bytes(r.payload)) for r in warc.read_archives(spark, f"{tmp_path}/two").collect() if r.payload is not None}
    assert (5, big.encode()) in read and (7, pages[6][2].encode()) in read
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_groups_hold_one_record(spark, tmp_path):
    """Many equal rows of a page in segments: each is a record of its own, and no group is larger than one record."""
    big = words(random.Random(2), 5000)
    rows = [(None, "u", big)] * 300 + [(7, "u", big)] * 200 + [(8, "v", big)] * 100
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = collected(warc.archive(df, path=str(tmp_path / "w")).select("page_id", "payload_bytes", "record_type", "refers_to"))
    assert got == {(None, len(big), "response", None): 300, (7, len(big), "response", None): 200, (8, len(big), "revisit", 7): 100}
    sizes = warc.read_records(spark, str(tmp_path / "w")).groupBy("origin").count()
    assert sizes.agg(F.max("count")).first()[0] <= len(big) // warc.SEGMENT + 2 and sizes.count() == 600


def test_warc_finds_missing_segments(spark):
    record = lambda n, total, block: ("o", n, total, "response", None, "sha1:x", bytearray(block), None)
    good = spark.createDataFrame([record(2, 5, b"de"), record(1, None, b"abc")], warc.PARTS)
    assert bytes(warc.reassembled(good).first().block) == b"abcde"
    for bad in ([record(1, None, b"abc")], [record(1, None, b"abc"), record(2, 9, b"de")], [record(1, None, b"a"), record(3, 2, b"b")], [record(0, None, b"a"), record(0, None, b"a")]):
        with pytest.raises(Exception, match="segments are missing"):
            warc.reassembled(spark.createDataFrame(bad, warc.PARTS)).collect()


def brute_suffixes(rows, length):
    hashed = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in hashed:
        data, gone = text.encode(), bytearray(len(text.encode()))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return Counter((r[0], *out[r[0], r[1] or ""]) for r in rows)


@pytest.mark.parametrize(("length", "most"), [(100, 256), (30, 256), (30, 1), (9, 2)])
def test_suffixes_as_brute_force(docs, rows, empty, monkeypatch, length, most):
    monkeypatch.setattr(suffixes, "MOST_UNITS", most)
    single = [r for r in rows if r[0] != 41]  # which of two texts with one id is earlier depends on their hashes
    got = collected(suffixes.suffix_digests(docs.where("doc_id <> 41 or doc_id is null"), length))
    assert got == brute_suffixes(single, length)
    assert suffixes.suffix_digests(docs, length).count() == len(rows)
    assert suffixes.suffix_digests(empty, length).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    for letters, n, depth in ((2, 300, 20), (1, 50, 8), (4, 800, 12), (200, 500, 9), (3, 400, 5)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        wanted = np.sort(rng.choice(n - depth, (n - depth) // 2, replace=False))
        order, common = suffixes.sort_suffixes(data, wanted, depth)
        strings = [bytes(data[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == wanted.tolist()
        assert strings == sorted(strings)
        assert common.tolist()[1:] == [a == b for a, b in zip(strings, strings[1:], strict=False)]


def test_simhash_as_brute_force(docs, rows, empty):
    prints = [simhash.fingerprint((r[1] or "").encode()) & (2**64 - 1) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    assert collected(simhash.near_duplicates(docs)) == Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.drop_near_duplicates(empty).count()


def test_fingerprint_by_bits():
    for text in ("", "One", "one two", "a b c d a b c", "x " * 50):
        ws = text.lower().split()
        shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want


@pytest.mark.parametrize("most", [256, 3])
def test_close_pairs_lose_no_connection(spark, most):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for b in base for _ in range(40)} | set(base)
    signed = [x - (x >> 63 << 64) for x in near]
    found = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, most)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in found.collect())
    roots = {r.node: r.root for r in components.components(found).collect()}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                assert roots[a] == roots[b]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (7, 7), (200, 100)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_as_brute_force(docs, rows, empty):
    single = [r for r in rows if r[0] != 41]
    seen, out = set(), {}
    for doc, text in distinct(single):
        ls = text.split("\n")
        cover = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                cover |= {i, i + 1, i + 2}
            seen.add(w)
        out[doc, text] = (len(ls), len(cover), "\n".join(x for i, x in enumerate(ls) if i not in cover))
    kept = lines.drop_repeated_lines(docs.where("doc_id <> 41 or doc_id is null"), removed="gone")
    want = Counter((r[0], None if r[1] is None else out[r[0], r[1]][2], *r[2:], out[r[0], r[1] or ""][1]) for r in single)
    assert collected(kept) == want
    assert sum(n for *_, n in want) > 6
    assert lines.line_digests(empty).count() == 0 and lines.line_digests(docs).count() == len(rows)


def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[42].n_words, got[42].n_base, got[42].first_word, got[42].last_word) == (12, 4, 1, 9)
    assert got[42].base_labels == "apache,gpl,mit" and got[42].score == 1.0
    assert got[37].base_labels == "mit" and got[30].n_words == 0 and got[31].first_word is None and got[30].labels == ""
    assert licenses.scan_licenses(empty).count() == 0


def test_license_base_columns_as_brute_force(spark, docs, rows):
    rng = random.Random(15)
    bits = ["MIT", "License", "apache", "general", "public", "license", "the", "ünï", "-", "a1"]
    extra = [(500 + i, rng.choice([" ", ".", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(200)]
    want = Counter()
    for doc, text in [(r[0], r[1]) for r in rows] + extra:
        ws = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.encode().split()]
        starts = [i for i, _ in places]
        want[doc, len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.scan_licenses(every)
    assert collected(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    assert sum(k[2] for k in want) > 50
    for r in got.collect():
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_chain_as_brute_force():
    rng = random.Random(14)
    for _ in range(400):
        gap, pieces = rng.randrange(1, 6), set()
        for _ in range(rng.randrange(1, 9)):
            s, n, ts = rng.randrange(30), rng.randrange(3, 7), rng.randrange(12)
            pieces.add((s, s + n, ts, ts + n))
        chain, order = licenses.Chain(gap, 18), sorted(pieces, key=lambda x: (x[1], x[0]))
        for p in order:
            chain.add(p)
        best, chains = 0, []
        for s, e, ts, te in order:
            grown = [(te - ts, e, te)]
            for covered, end, tend in chains:
                cut = max(0, end - s, tend - ts)
                if s - end <= gap and cut < e - s and end < e and tend < te:
                    grown.append((covered + te - ts - cut, e, te))
            chains += grown
            best = max([best, *(x[0] for x in grown)])
        assert chain.best[0] == best


def test_each_copy_of_a_license_is_a_span(spark):
    text = licenses.TEMPLATES["isc"][0]
    n = len(licenses.words_of(text.encode()))
    docs = spark.createDataFrame([(1, f"{text} {text} between these {text}"), (2, text), (2, text)], "doc_id long, text string")
    rows = licenses.scan_licenses(docs).collect()
    spans = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans] for r in rows}
    assert spans[1] == [("isc", 0, n), ("isc", n, 2 * n), ("isc", 2 * n + 2, 3 * n + 2)] and spans[2] == [("isc", 0, n)]
    assert len(rows) == 3


def test_license_spans(spark):
    text = licenses.TEMPLATES["bsd"][0]
    cut = text.replace("with or without modification", "with or even without modification")
    half = " ".join(text.split()[:8])
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(1, f"intro words {text} more"), (2, cut), (3, half)], "doc_id long, text string")).collect()}
    assert rows[1].labels == "bsd" and (rows[1].spans[0].start, rows[1].spans[0].end, rows[1].score) == (2, 2 + len(licenses.words_of(text.encode())), 1.0)
    assert rows[2].labels == "bsd" and rows[2].spans[0].share >= 0.9
    assert rows[3].labels == "" and rows[3].score == 0


def notice(program="program", kind="", version="3", sep=(":", ",")):
    return f"This {program} is free software{sep[0]} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep[1]} either version {version} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (notice(), {"gpl"}),
        (notice(version="2"), {"gpl"}),
        (notice(kind="Affero "), {"agpl"}),
        (notice(kind="Lesser "), {"lgpl"}),
        (notice("library", "Lesser "), {"lgpl"}),
        (notice("library", "Lesser ", "2.1", (";", ";")), {"lgpl"}),
        ("Licensed under CC BY-NC 4.0", {"cc-by-nc"}),
        ("Licensed under CC BY 4.0", {"cc-by"}),
        ("Licensed under the GNU Affero General Public License", {"agpl"}),
        (" ".join(licenses.TEMPLATES["bsd"]), {"bsd"}),
        (" ".join(x for x in licenses.TEMPLATES["bsd"] if "Neither" not in x), {"bsd"}),
        (" ".join(licenses.TEMPLATES["isc"]), {"isc"}),
        (" ".join(licenses.TEMPLATES["boost"]), {"boost"}),
        (" ".join(licenses.TEMPLATES["zlib"]), {"zlib"}),
        (notice() + " and " + notice(kind="Lesser "), {"gpl", "lgpl"}),
    ],
)
def test_licenses_that_differ_in_a_word(text, labels):
    scanner = licenses.Scanner(3, 20, 0.8)
    spans = scanner.scan(f"some words before {text} and after".encode())[7]
    assert {s[0] for s in spans} == labels
    changed = text.replace("redistribute", "spread", 1)
    assert {s[0] for s in scanner.scan(changed.encode())[7]} == labels


def test_matches_of_all_templates_as_brute_force(monkeypatch):
    """Every common substring of a text and a template that can't be made longer to the right, and is longest to the left, is a piece."""
    rng = random.Random(9)
    templates = {"x": ["a b c a b d e", "c a b e f", "b b b a"], "y": ["d a b c e", "a b c a b d f"]}
    listed = [(label, t.split()) for label, ts in sorted(templates.items()) for t in ts]
    monkeypatch.setattr(licenses, "TEMPLATES", templates)
    monkeypatch.setattr(licenses, "BASE_PHRASES", {"a b": "p"})
    scanner = licenses.Scanner(2, 5, 0.6)
    for _ in range(300):
        said = [rng.choice("abcdefz") for _ in range(rng.randrange(25))]
        want = {}
        for t, (_, ws) in enumerate(listed):
            for i in range(len(said)):
                for p in range(len(ws)):
                    n = 0
                    while n <= min(i, p) and said[i - n] == ws[p - n]:
                        n += 1
                    goes_on = i + 1 < len(said) and p + 1 < len(ws) and said[i + 1] == ws[p + 1]
                    if n >= 2 and not goes_on:
                        want.setdefault(t, set()).add((i - n + 1, i + 1, p - n + 1, p + 1))
        got = {}
        monkeypatch.setattr(scanner, "spans", lambda t, ps, got=got: got.update({t: set(ps)}) or [])
        scanner.scan(" ".join(said).encode())
        assert got == want


def test_the_better_of_overlapping_spans():
    rng = random.Random(10)
    for _ in range(300):
        spans = [(rng.choice("abc"), s, s + rng.randrange(1, 9), 1.0, rng.choice((0.8, 0.9, 1.0))) for s in (rng.randrange(30) for _ in range(rng.randrange(12)))]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[4], s[1] - s[2], s[1], s[0])):
            over = [k for k in kept if k[0] != s[0] and (k[4], k[2] - k[1]) > (s[4], s[2] - s[1]) and 2 * (min(k[2], s[2]) - max(k[1], s[1])) >= min(k[2] - k[1], s[2] - s[1]) and min(k[2], s[2]) > max(k[1], s[1])]
            kept += [] if over else [s]
        assert sorted(licenses.best_of(iter(spans))) == sorted(kept)


def test_matching_statistics():
    a = licenses.Automaton({"x": ["a b c a b d", "c a b e", "b b b"], "y": ["d a"]}, {"a b": "p", "b": "q"})
    texts = [t.split() for t in ("a b c a b d", "c a b e", "b b b", "d a", "a b", "b")]
    names = {i: w.decode() for w, i in a.vocabulary.items()}
    rng = random.Random(2)
    for _ in range(200):
        tokens = [rng.randrange(len(names)) for _ in range(rng.randrange(12))]
        said = [names[t] for t in tokens]
        for i, (state, n) in enumerate(a.statistics(tokens)):
            inside = lambda m, i=i: m == 0 or any(said[i - m + 1 : i + 1] == t[j : j + m] for t in texts for j in range(len(t)))
            assert n == max(m for m in range(i + 2) if inside(m))
            places = {a.phrases[p][0] for p in a.said[state] if n >= a.phrases[p][1]}
            assert places == {label for label, p in (("p", ["a", "b"]), ("q", ["b"])) if said[max(0, i - len(p) + 1) : i + 1] == p}


def test_quality_held_out(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the of and to in is was for on with".split()) + " " + words(rng, 1) for _ in range(40))
    bad = lambda: " ".join(words(rng, 1).upper() + "!!" for _ in range(60))
    rows = [(i, bad() if i % 6 == 0 else good()) for i in range(600)]
    rows += [(None, good()), (700, None), (701, ""), (702, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, weight string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_quality(docs, labels)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    held_out = range(300, 600)
    assert kept.columns == docs.columns
    assert sum((i in ids) == (i % 6 != 0) for i in held_out) >= 0.99 * len(held_out)
    drawn = quality.resample(docs, labels, k=50)
    assert drawn.count() in (50, 51)  # the repeated row stays or goes with its twin
    assert collected(drawn) == collected(quality.resample(docs.repartition(5), labels, k=50))
    assert quality.resample(docs, labels.limit(0)).count() == len(rows)
    assert quality.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("size", [1 << 22, 1 << 13])
def test_quality_as_brute_force(spark, docs, rows, monkeypatch, size):
    """Counts, ratios, weights and keys again, one n-gram at a time."""
    monkeypatch.setattr(quality, "SLICE", size)
    buckets, mask = 1 << 15, 2**64 - 1
    kind = lambda b: 0 if b in b" \t\n\r\x0b\x0c" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5

    def grams(text):
        ws, factor = (text or "").encode().split(), 0x9E3779B97F4A7C15
        h = [xxhash.xxh64_intdigest(w) for w in ws]
        out = h + [((a ^ (b >> 7)) * factor + b) & mask for a, b in zip(h, h[1:], strict=False)]
        shape = [((kind(w[0]) * 8 + kind(w[min(1, len(w) - 1)])) * 256 + w[-1] + 1) * factor & mask for w in ws]
        out += shape + [((shape[i] * factor + shape[i + 1] + (h[i] == h[i + 1])) * factor) & mask for i in range(len(ws) - 1)]
        return [(x ^ (x >> 33)) % buckets for x in out]

    target = {0, 2, 4, 36}
    raw, own = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in target:
            own.update(grams(r[1]))
    counts = quality.ngram_counts(docs, target, buckets)
    assert {(r.bucket, r.raw, r.own) for r in counts.collect()} == {(b, n, own[b]) for b, n in raw.items()}
    share = own.total() / raw.total()
    ratio = {b: np.log((own[b] + 10) / (n * share + 10)) for b, n in raw.items()}
    want = Counter((r[0] if r[0] is not None else -(2**63), len(grams(r[1])), round(sum(ratio[g] for g in grams(r[1])), 3)) for r in rows)
    scored = quality.scores(docs, counts, buckets)
    assert Counter((r.dk, r.n, round(r.weight, 3)) for r in scored.collect()) == want

    drawn = scored.select("dk", "th", (quality.gumbel(8)).alias("g"), quality.order_key(F.col("weight") + quality.gumbel(8)).alias("key"), "weight").collect()
    assert all(abs(r.key / 2**20 - r.weight - r.g) < 1e-5 for r in drawn)
    labels = spark.createDataFrame([(i, 1) for i in target], "doc_id long, quality int")
    fitting, _ = quality.labelled_sample(labels, quality.LABELLED)
    assert len(fitting) == 2
    mine = quality.resample(docs, labels, k=9, buckets=buckets)
    again = quality.scores(docs, quality.ngram_counts(docs, set(fitting), buckets), buckets)
    keys = [(r.key, r.dk, r.th) for r in again.select(quality.order_key(F.col("weight") + quality.gumbel(8)).alias("key"), "dk", "th").collect()]
    last = sorted(keys, key=lambda r: (-r[0], *r[1:]))[8]
    assert {(r.dk, r.th) for r in mine.collect()} == {(d, t) for k, d, t in keys if (-k, d, t) <= (-last[0], *last[1:])}


def test_quality_buckets_grow(spark):
    docs = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 100_000).alias("text"))
    assert quality.bucket_count(docs(0)) == 1 << 15
    assert quality.bucket_count(docs(400)) == 1 << 19 == 2 * quality.bucket_count(docs(100))


def test_ties_at_the_end_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(7, "same words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    order = [r.dk for r in quality.resample(docs, labels, k=41).orderBy(F.desc("key"), "dk").collect()]
    for k in (1, 5, 40):
        assert sorted(set(order[:k])) == sorted({r.dk for r in quality.resample(docs, labels, k=k).collect()})


def test_top_share(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([5, 5, 5, -3, 2**40, rng.getrandbits(30)]), rng.choice([-(2**63), 1, 2, 3]), rng.getrandbits(62)) for _ in range(200)]
    keys = spark.createDataFrame(rows, "key long, dk long, th long")
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for few in (10_000, 20, 0):
        monkeypatch.setattr(quality, "FEW", few)
        for k in (1, 57, 120, 200):
            assert quality.top_share(keys, k) == order[k - 1]


def test_topk_as_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.integers(-3, 4, 6) / 7).tolist()) for i in range(160)]
    vectors += [(200 + i, vectors[0][1]) for i in range(20)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (50, vectors[50][1]), (304, [1.0, 2.0]), (350, [3.0, 1.0])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, score int").repartition(4)
    q = topk.quantized(df)
    good = {(i, tuple(np.floor(np.float32(v).astype(float) * 256).astype(int).tolist())) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = Counter()
    for i, a in good:
        if i % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in good if j != i and len(a) == len(b))[:5]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(near))
    for blocks, shards, fan in ((2048, 8192, 16), (2, 7, 2)):
        assert collected(topk.top_k(q, q.where("vec_id % 50 = 0"), 5, blocks, shards, fan)) == want
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_topk_keeps_large_components(spark):
    rows = [(0, [0.0, 2e16]), (1, [1.0, 0.0]), (2, [2.0, -1 / 256]), (3, [0.5, 0.0]), (4, [3.0, 1e-9])]
    q = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = [tuple(r) for r in topk.top_k(q, q.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 0), (0, 2, 3, 0), (0, 3, 4, 0)]  # 2 scores less
    with pytest.raises(Exception, match="too large"):
        topk.quantized(spark.createDataFrame([(0, [1e308])], "vec_id long, embedding array<double>")).collect()


def test_exact_products():
    a = np.array([[2**31, -(2**20)], [1, 1]], np.float64)
    assert topk.products(a, a).tolist() == [[2**62 + 2**40, 2**31 - 2**20], [2**31 - 2**20, 2]]


@pytest.mark.parametrize(("window", "most", "held"), [(35, 4096, 10_000), (10, 4096, 2), (3, 4096, 10_000), (1, 4096, 10_000), (35, 1, 3), (10, 1, 10_000)])
def test_substrings_as_brute_force(docs, rows, empty, monkeypatch, window, most, held):
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most)
    monkeypatch.setattr(substrings, "HELD_ROWS", held)
    texts = {(r[0], r[1] or "") for r in rows}
    split = {t: t[1].encode().split() for t in texts}
    count = Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    want = Counter()
    for r in rows:
        w = split[r[0], r[1] or ""]
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert collected(substrings.substring_digests(docs, window)) == want
    assert substrings.substring_digests(empty, window).count() == 0


def test_extension_as_brute_force():
    rng = random.Random(10)
    reach, rows = 6, []
    for _ in range(400):
        key = rng.randrange(3)
        rows.append((key, [rng.choice("ab") for _ in range(rng.choice([reach, reach, 2]))], [rng.choice("ab") for _ in range(rng.choice([reach, 3, 0]))]))
    join = lambda ws: " ".join(ws).encode()
    got = list(substrings.extended(np.array([r[0] for r in rows]), [join(reversed(r[1])) for r in rows], [join(r[2]) for r in rows], reach))
    for s in range(reach + 1):
        seen = lambda r, s=s: (r[0], *r[1][:s], "|", *r[2][: reach - s]) if len(r[1]) >= s and len(r[2]) >= reach - s else None
        count = Counter(map(seen, rows))
        assert got[s].tolist() == [i for i, r in enumerate(rows) if seen(r) and count[seen(r)] > 1]


def test_covers_reach_every_shift():
    for period, cover in substrings.COVERS.items():
        for shift in range(period):
            assert any((c + shift) % period in cover for c in cover)
