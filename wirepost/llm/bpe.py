"""BPE encoding and decoding: speculate by greedy longest match, verify adjacent pairs, merge exactly only where that fails.

A split of a word into tokens is the one that BPE's merges give if and only if each token is what BPE makes of its own
characters and no merge across a boundary comes before the merges that build the two tokens beside it. Both tests read
only the merge ranks, so they run on arrays: all adjacent pairs of a batch at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, blocks, doc_id, keyed

#: Stands for the end of a word; the alphabet of byte-level vocabularies has no such character.
END = "\0"
NO_RANK_INT = 2**40
NO_RANK = np.int64(NO_RANK_INT)
#: Pieces between spaces whose tokens a worker remembers at most, twice over: it keeps the last two generations.
REMEMBERED = 250_000
#: Code points that Python's split() takes for white space and the vocabulary's pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\s+")
#: Words with more symbols than this are merged with a heap instead of by scans.
SCANNED = 64


def byte_alphabet() -> list[str]:
    """The printable character for each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """A tokenizers file of the kind that word_bpe_49k.json is: BPE on words with an end-of-word suffix."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        mark = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) and t != self.suffix else t
        self.ids = {mark(t): i for t, i in model["vocab"].items()}
        n = max(self.names) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)  # of the merge that builds the token; -1: a single character
        codes, ranks, self.merges = [], [], {}
        for k, pair in enumerate(model["merges"]):
            a, b = (mark(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[i, j] = (k, made)
            codes.append(i * n + j)
            ranks.append(k)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = i, j, k
        order = np.argsort(codes)
        self.n, self.codes, self.ranks = n, np.array(codes)[order], np.array(ranks)[order]
        self.reach: dict[str, int] = {}  # the longest token with these first two characters
        for t in self.ids:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.whole = self.checked_tokens()
        self.alphabet = byte_alphabet()
        self.translate = {b: c for b, c in enumerate(self.alphabet)}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NO_RANK)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge that joins the ends of a and b comes before rank `limit` or before the merges around the boundary.

        Takes the merges beside the boundary back, the latest first. A merge across it that ranks before the one just taken
        back would have come first; of equal ranks the left one does, so a tie counts against the right token only.
        """
        a, b, limit = a.copy(), b.copy(), limit.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            bad = self.pair_rank(x, y) < limit[open_]
            good[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = bad | ((rx < 0) & (ry < 0))
            from_left = rx > ry
            lim = np.where(from_left, rx, ry + 1)
            a[open_] = np.where(from_left, self.right[x], x)
            b[open_] = np.where(from_left, y, self.left[y])
            limit[open_] = lim
            open_ = open_[~done]
        return good

    def checked_tokens(self) -> np.ndarray:
        """Whether BPE makes the token of its own characters, for each token."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.zeros(self.n, bool)
        good[[i for t, i in self.ids.items() if len(t.rstrip(END)) == 1]] = True
        fine = np.zeros(self.n, bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:  # the parts come before the whole
            good[i] = fine[i] and good[self.left[i]] and good[self.right[i]]
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if some character is unknown."""
        ids, reach, out, at, n = self.ids, self.reach, [], 0, len(word)
        while at < n:
            to = min(n, at + reach.get(word[at : at + 2], 1))
            if to == n - 1:  # never leave the end mark alone
                to -= 1
            while to > at and word[at:to] not in ids:
                to -= 1 + (to == n)
            if to <= at:
                return None
            out.append(ids[word[at:to]])
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """BPE as defined: the merge of lowest rank first, the leftmost of equals. Unknown characters are dropped."""
        symbols = list(word[:-2]) + [word[-2:]]
        ids = [self.ids[s] for s in symbols if s in self.ids]
        if len(ids) > SCANNED:
            return self.merge_long(ids)
        get, none = self.merges.get, (NO_RANK_INT, -1)
        steps = [get(p, none) for p in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best is none or best[0] == NO_RANK_INT:
                break
            i = steps.index(best)
            ids[i : i + 2] = [best[1]]
            del steps[i]
            if i:
                steps[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(steps):
                steps[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (m := self.merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word; a word is in the byte alphabet and ends with END."""
        proposed = [self.propose(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p or ()) for p in proposed])
        flat = np.array([i for p in proposed for i in p or ()], np.int64)
        fails = np.array([p is None for p in proposed], bool)
        fails[owner[~self.whole[flat]]] = True
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[beside] * self.n + flat[beside + 1], return_inverse=True)
        fine = self.compatible(pairs // self.n, pairs % self.n, np.full(len(pairs), NO_RANK))
        fails[owner[beside[~fine[where]]]] = True
        return [self.merge(w) if bad else p for w, p, bad in zip(words, proposed, fails.tolist(), strict=True)]


class Encoder:
    """Encodes and decodes texts; remembers the tokens of the pieces between spaces that it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.seen, self.older = vocabulary, {}, {}
        self.names = np.array([vocabulary.names.get(i, "") for i in range(vocabulary.n)], object)
        self.known = np.array([i in vocabulary.names for i in range(vocabulary.n)])

    def pieces(self, text: str) -> list[str]:
        """Compose, lower-case each character by itself, split at white space: no word of the pattern crosses it."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [p for p in WHITE.split(text) if p] if ODD_SPACE.search(text) else text.split()

    def learn(self, pieces: set[str]) -> None:
        """Put the tokens of all pieces into self.seen, as little-endian int32."""
        new = pieces - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.older, self.seen = self.seen, {}
            new = pieces
        known = new & self.older.keys()
        self.seen.update((p, self.older[p]) for p in known)
        new = list(new - known)
        words = [[p] if p.isascii() and p.isalpha() else self.v.word.findall(p) for p in new]
        distinct = list({w for ws in words for w in ws})
        spelled = [w + END if w.isascii() and w.isprintable() else "".join(map(self.v.alphabet.__getitem__, w.encode())) + END for w in distinct]  # the alphabet leaves ASCII symbols as they are
        tokens = {w: array("i", ids).tobytes() for w, ids in zip(distinct, self.v.encode_words(spelled), strict=True)}
        self.seen.update((p, b"".join([tokens[w] for w in ws])) for p, ws in zip(new, words, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        v = self.v
        split = [v.split_special.split(t) if v.split_special and "<|" in t else [t] for t in texts]  # special tokens stand at odd places
        rows = [[[p] if i % 2 else self.pieces(p) for i, p in enumerate(row)] for row in split]
        self.learn({p for row in rows for ps in row[::2] for p in ps})
        special = {t: np.array([i], "<i4").tobytes() for t, i in v.special.items()}
        get, tag = self.seen.__getitem__, special.__getitem__
        return [np.frombuffer(b"".join([x for i, ps in enumerate(row) for x in map(tag if i % 2 else get, ps)]), "<i4") for row in rows]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder, so a text is its tokens' names, joined by a space; unknown ids are skipped."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < self.v.n)]
        return " ".join(self.names[ids[self.known[ids]]].tolist())


def load(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file that Spark handed out; built once in a worker."""
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name] = Encoder(Vocabulary(f.read()))
    return _loaded[name]


_loaded: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, vocabulary: str, block: int = 2_000_000) -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row of docs (doc_id, text).

    `vocabulary` is the path of a tokenizers file on the driver. Texts are encoded whole. Null texts are empty; empty texts
    have no ids and decode to the empty string. Rows that repeat an id each give a row; a null id stays null. An empty
    table gives none. Other columns are ignored. One narrow pass: no shuffle, so no key can be hot.
    """

    def run(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        ids = encoder.encode(texts)
        offsets = np.cumsum([0, *map(len, ids)])
        flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<i4")])))
        return [flat, pa.array(list(map(encoder.decode, ids)), pa.string())]

    return _mapped(docs, vocabulary, block, run, "ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, block: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_decode() reduced to digests where the ids are, so that they don't leave the worker."""

    def run(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        ids = encoder.encode(texts)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return [
            pa.array(list(map(len, ids)), pa.int64()),
            pa.array([sha(" ".join(map(str, row.tolist()))) for row in ids]),
            pa.array([sha(encoder.decode(row)) for row in ids]),
        ]

    return _mapped(docs, vocabulary, block, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, vocabulary: str, block: int, run, columns: str) -> DataFrame:
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    names = [c.split()[0] for c in columns.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(name)
        for batch in blocks(batches, "text", block):
            yield pa.RecordBatch.from_arrays([batch.column("dk"), *run(encoder, batch.column("text").to_pylist())], ["dk", *names])

    out = keyed(docs).mapInArrow(mapped, f"dk long, {columns}")
    return out.select(doc_id(), *map(F.col, names))


__all__ = ["NULL_ID", "Encoder", "Vocabulary", "digests", "encode_decode"]
