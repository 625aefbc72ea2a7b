"""Main text of web pages: tokens that occur alike on all pages of a host are its template; the article is the slot that holds the text."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import Page, parsed
from .shared import blocks, byte_values, discard, fresh, materialize, mix, same_keys

#: A class of tokens is looked at if it is on one of so many pages of its host at least.
SHARE = 5
#: Text that a class repeats is template text if it does so on as many pages at least.
REPEATED = 5
#: Share of a page's text that the container of the main text holds at least, where no element says which it is.
MAIN = 0.8

BLOCK = "struct<text: string, path: array<long>, leaf: boolean, heading: boolean, size: long, run: long>"
PARSED = f"page_id long, url string, hk long, tokens array<struct<token: long, lo: long, hi: long>>, sequence array<long>, kinds array<struct<token: long, kind: int>>, own long, blocks array<{BLOCK}>"


def own_container(page: Page, kept: list) -> int:
    """The container of the main text, as the page alone shows it: its largest article, else its main element, else the
    innermost container with a heading (or the innermost) of those that hold most of the text."""
    sizes, heads, depth = Counter(), set(), {0: 0}
    for b in kept:
        for k, token in enumerate(b.chain):
            depth.setdefault(token, k)
        for token in set(b.chain):
            sizes[token] += len(b.text) - b.linked
        if b.heading:
            heads.add(b.chain[-1])
    best = [(page.kinds[t], n if page.kinds[t] else 0, t in heads, depth[t], t) for t, n in sizes.items() if page.kinds[t] or n >= MAIN * sizes[0]]
    return max(best)[-1] if best else 0


def row_of(source: str) -> dict:
    page = parsed(source)
    level = 0 if any(not b.apart for b in page.blocks) else 1
    kept = [b for b in page.blocks if b.apart <= level]
    runs = [0 if b.leaf else xxhash.xxh64_intdigest(b.text, b.chain[-1]) >> 1 for b in page.blocks]
    sequence, at = [], 0
    for b, run in zip(page.blocks, runs, strict=True):
        sequence += page.marks[at : b.mark]
        at = b.mark
        if run:
            sequence.append(run)
    sequence += page.marks[at:]
    mine = xxhash.xxh64_intdigest(source)
    counts = Counter(sequence)
    terms = mix(np.uint64(mine) ^ (np.fromiter(counts.values(), np.uint64, len(counts)) * np.uint64(0x9E3779B97F4A7C15)))
    by_block = {id(b): run for b, run in zip(page.blocks, runs, strict=True)}
    return {
        "tokens": [{"token": t, "lo": int(x) & 0xFFFFFFFF, "hi": int(x) >> 32} for t, x in zip(counts, terms.tolist(), strict=True)],
        "sequence": sequence,
        "kinds": [{"token": t, "kind": k} for t, k in page.kinds.items() if k],
        "own": own_container(page, kept),
        "blocks": [{"text": b.text, "path": list(b.chain), "leaf": b.leaf, "heading": b.heading, "size": len(b.text) - b.linked, "run": by_block[id(b)]} for b in kept],
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """A row for each page (page_id, url, html): its tokens with their terms of the occurrence vector, their sequence, and its blocks.

    Tokens are containers by their path, and runs of text that stand in a container itself. A token's term is a hash of the
    page and of how often the token occurs in it; the sum of terms over a host's pages stands for the whole vector.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host).alias("hk"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], PARSED).schema.fields}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in blocks(batches, "html", 2_000_000):
            made = [row_of(x.decode()) for x in byte_values(batch.column("html"))]
            new = {c: pa.array([r[c] for r in made], to_arrow_type(kinds[c])) for c in ("tokens", "sequence", "kinds", "own", "blocks")}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "hk")), *new.values()], [*("page_id", "url", "hk"), *new])

    return rows.mapInArrow(mapped, PARSED)


def frequent_tokens(rows: DataFrame) -> DataFrame:
    """(hk, token, lo, hi, n): tokens on a fifth of their host's pages at least, with the sums that stand for their vectors.

    Token 0 is the page itself, so its n is the host's number of pages. Hosts of one page have no template. A host has at
    most five times as many such tokens as a page of it has on average.
    """
    stats = rows.select("hk", F.inline("tokens")).groupBy("hk", "token").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.count("*").alias("n")).where("n > 1")
    hosts = stats.where("token = 0").select(F.col("hk").alias("hk2"), F.col("n").alias("host_n"))
    return stats.join(hosts, same_keys(("hk", "hk2"))).where(F.col("n") * SHARE >= F.col("host_n")).select("hk", "token", "lo", "hi", "n")


def checked(sequence: list[int], members: dict[int, tuple[int, int]], root: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, order, slot) of each class that the page has: a hash of the order of its tokens if they repeat in one order,
    and the slot of the root class that they are all in; -1 for those that don't."""
    found: dict[tuple[int, int], list[int]] = defaultdict(list)
    slots: dict[tuple[int, int], set[int]] = defaultdict(set)
    slot = 0
    for token in sequence:
        own = members.get(token)
        if own is None:
            continue
        if own == root:
            slot = token
        else:
            slots[own].add(slot)
        found[own].append(token)
    for own, tokens in found.items():
        m = len(set(tokens))
        tuples, rest = divmod(len(tokens), m)
        order = -1 if rest or tokens[:m] * tuples != tokens else xxhash.xxh64_intdigest(np.array(tokens[:m], np.int64).tobytes()) >> 1
        yield *own, order, 0 if own == root else next(iter(slots[own])) if len(slots[own]) == 1 else -1


def valid_classes(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(hk, lo, hi): classes of at least two tokens whose tokens are ordered (in one order on all pages, tuple by tuple) and nested (in one slot of the root class)."""
    of_host = tokens.groupBy("hk").agg(F.collect_list(F.struct("token", "lo", "hi")).alias("members")).select(F.col("hk").alias("hk2"), "members")
    met = rows.select("hk", "sequence").join(of_host, same_keys(("hk", "hk2"))).select("hk", "sequence", "members")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[int, tuple[dict, tuple]] = {}
        for batch in batches:
            out: dict[tuple[int, int, int], list[int]] = {}
            for i, (hk, sequence) in enumerate(zip(batch.column("hk").to_pylist(), batch.column("sequence").to_pylist(), strict=True)):
                if hk not in hosts:
                    if len(hosts) >= 1000:
                        hosts.clear()
                    members = {m["token"]: (m["lo"], m["hi"]) for m in batch.column("members")[i].as_py()}
                    hosts[hk] = members, members[0]
                for lo, hi, order, slot in checked(sequence, *hosts[hk]):
                    x = out.setdefault((hk, lo, hi), [order, order, slot, slot])
                    x[:] = min(x[0], order), max(x[1], order), min(x[2], slot), max(x[3], slot)
            columns = list(zip(*((*k, *v) for k, v in out.items()), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hk", "lo", "hi", "o1", "o2", "s1", "s2"])

    told = met.mapInArrow(mapped, "hk long, lo long, hi long, o1 long, o2 long, s1 long, s2 long")
    told = told.groupBy("hk", "lo", "hi").agg(F.min("o1").alias("o1"), F.max("o2").alias("o2"), F.min("s1").alias("s1"), F.max("s2").alias("s2"))
    valid = told.where("o1 = o2 AND o1 >= 0 AND s1 = s2 AND s1 >= 0").select("hk", "lo", "hi")
    sizes = tokens.groupBy("hk", "lo", "hi").agg(F.count("*").alias("members")).where("members > 1")
    return valid.join(sizes.select(F.col("hk").alias("hk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), (F.col("hk") == F.col("hk2")) & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2"))).select("hk", "lo", "hi")


def fixed_runs(tokens: DataFrame, valid: DataFrame) -> DataFrame:
    """(hk, fixed): pairs of a token and its class for the tokens of valid classes on REPEATED pages at least."""
    v = valid.select(F.col("hk").alias("hk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = tokens.where(F.col("n") >= REPEATED).join(v, (F.col("hk") == F.col("hk2")) & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")))
    return met.groupBy("hk").agg(F.map_from_entries(F.collect_list(F.struct("token", F.xxhash64("lo", "hi")))).alias("fixed")).select(F.col("hk").alias("hk2"), "fixed")


def template_text(b: Column, main: Column) -> Column:
    """A block that stands in a container below main, of which text and container are one class of the template."""
    inner = F.element_at(b["path"], -1)
    same = F.try_element_at(F.col("fixed"), b["run"]) == F.try_element_at(F.col("fixed"), inner)
    return F.coalesce(same, F.lit(False)) & (b["run"] != 0) & (inner != main)


def containers(rows: DataFrame) -> DataFrame:
    """(hk, main): the container of the main text of each host's pages: an article with most text, else a main element, else
    the innermost container with a heading (or the innermost) of those that hold most of the text outside the template."""
    free = rows.select("hk", "kinds", F.filter("blocks", lambda b: ~template_text(b, F.lit(-1))).alias("blocks"))
    each = free.select("hk", "kinds", F.explode("blocks").alias("b"))
    levels = F.transform("b.path", lambda t, i: F.struct(t.alias("token"), i.alias("depth")))
    at = each.select("hk", F.map_from_entries("kinds").alias("kinds"), F.col("b.size").alias("size"), (F.col("b.heading")).alias("heading"), F.element_at("b.path", -1).alias("inner"), F.explode(levels).alias("c"))
    sums = at.groupBy("hk", F.col("c.token").alias("token")).agg(
        F.sum("size").alias("size"), F.min("c.depth").alias("depth"), F.max(F.coalesce(F.try_element_at("kinds", "c.token"), F.lit(0))).alias("kind"), F.max(F.col("heading") & (F.col("inner") == F.col("c.token"))).alias("heading")
    )
    sums = sums.where("size > 0")
    totals = sums.where("token = 0").select(F.col("hk").alias("hk2"), F.col("size").alias("total"))
    fit = sums.join(totals, same_keys(("hk", "hk2"))).where((F.col("kind") > 0) | (F.col("size") >= MAIN * F.col("total")))
    rank = F.struct("kind", F.when(F.col("kind") > 0, F.col("size")).otherwise(F.lit(0)), "heading", "depth", "token")
    return fit.groupBy("hk").agg(F.max_by("token", rank).alias("main")).select(F.col("hk").alias("hk3"), "main")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html): the main text of the page.

    Pages of one host (of the url, in lower case; pages without one count as one host) are compared. Tokens with one
    occurrence vector are a class; a class is valid if its tokens keep one order on all pages and lie in one slot of the
    class that is on every page. Containers and texts of valid classes are template. The main text is what one container
    holds: on the host's pages the article element with most text, else the main element, else the innermost container with
    most of the text that is not template. Within it all blocks stay but those that belong elsewhere by element (nav,
    footer, aside, form, the page's header, ...) or by a name in class, id or role (menu, cookie, comments, ...), and texts
    that a container of the template repeats on five pages at least; paragraphs stay however often they repeat. A page
    without that container is taken by itself, with the same rules; so are pages of hosts with one page.

    References are decoded, white space in a block is one space, blocks are joined by one space. Null, empty and broken html
    gives what text there is, or an empty text with n_chars 0; null ids and urls stay null; repeated rows each give a row; an
    empty table gives none. A page is parsed once, whole; the rest are sums by host that tasks start before the shuffle.
    """
    rows = materialize(parsed_pages(pages), "parsed", "zstd")
    tokens = materialize(frequent_tokens(rows), "tokens")
    fixed = materialize(fixed_runs(tokens, valid_classes(rows, tokens)), "fixed")
    with_fixed = rows.join(fixed, same_keys(("hk", "hk2")), "left").drop("hk2")
    mains = materialize(containers(with_fixed), "mains")
    discard(tokens)
    met = with_fixed.join(mains, same_keys(("hk", "hk3")), "left")
    there = F.exists("blocks", lambda b: F.array_contains(b["path"], F.col("main")))
    met = met.withColumn("main", F.when(there, F.col("main")).otherwise(F.col("own")))
    kept = F.filter("blocks", lambda b: F.array_contains(b["path"], F.col("main")) & ~template_text(b, F.col("main")))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The rows of pages, all columns, with main_texts()'s text and n_chars added (under other names where these are taken)."""
    text, n_chars = fresh(pages, "text", "n_chars")
    key, key2 = fresh(pages, "wirepost_row", "wirepost_row2")
    keyed = pages.withColumn(key, F.xxhash64(F.col(url), F.col(html)))
    found = main_texts(keyed.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).dropDuplicates(["page_id"]))
    found = found.select(F.col("page_id").alias(key2), F.col("text").alias(text), F.col("n_chars").alias(n_chars))
    return keyed.join(found, F.col(key) == F.col(key2), "left").drop(key, key2)
