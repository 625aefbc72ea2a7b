"""Main text of pages made from several layouts, and the classes of tokens against vectors written out."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from wirepost.llm import markup, templates


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()) + str(rng.randrange(300)) for _ in range(n))


def semantic(rng, paragraphs, title):
    body = "".join(f"<p>{p}" if rng.random() < 0.3 else f"<p class=x{rng.randrange(9)}>{p}</p>\n" for p in paragraphs)
    return f"<!doctype html><html><head><title>{title}</title><script>var a='<p>no</p>';</script><style>p>a{{}}</style></head><body class='has-sidebar'><header><h1>My site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>{title}</h1>{body}</article><section class=comments><article><p>{prose(rng, 80)}</p></article></section><aside>{prose(rng, 90)}</aside><footer>&copy; me</footer>"


def layered(rng, paragraphs, title):
    items = "".join(f"<div class=comment id=c{i}><p>{prose(rng, 12)}</p></div>" for i in range(rng.randrange(5)))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    notice = "<div>We have something to tell all of you about our terms.</div>"
    return f"<html><body><div id=wrap><div class='cookie-notice'>We use cookies {prose(rng, 30)}</div><div class=top><a href=/>Start</a> <a href=/b>{prose(rng, 3)}</a></div><div class=content><h1>{title}</h1>{notice}{body}</div><div class=side>{prose(rng, 6)}</div><div class=comments>{items}</div><form><input name=q>Search {prose(rng, 2)}</form></div></body></html>"


def tabled(rng, paragraphs, title):
    body = "<br><br>".join(paragraphs)
    return f"<TABLE><TR><TD><FONT SIZE=1>{prose(rng, 4)}</FONT><TR><TD><MAIN><H2>{title}</H2>{body}</MAIN></TABLE>"


LAYOUTS = {"a.example": semantic, "b.example:80": layered, "c.example": tabled}


@pytest.fixture(scope="module")
def made():
    rng, rows, want = random.Random(13), [], {}
    shared = prose(rng, 30)
    for host, layout in LAYOUTS.items():
        for i in range(9):
            paragraphs = [prose(rng, rng.randrange(20, 90)) for _ in range(rng.randrange(2, 7))] + [shared]
            title = prose(rng, 5)
            rows.append((len(rows), f"HTTP://{host}/{i}?q=//x", layout(rng, [p.replace("lorem", "l&amp;m  <b>&eacute;</b>o&nbsp;") for p in paragraphs], title)))
            want[len(rows) - 1] = title + " " + " ".join(paragraphs).replace("lorem", "l&m éo ")
    return rows, {k: " ".join(v.split()) for k, v in want.items()}


def test_main_text_of_several_layouts(spark, made):
    rows, want = made
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, hk long").repartition(3)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in templates.main_texts(pages).collect()}
    assert got == {i: (u, want[i], len(want[i])) for i, u, _ in rows}
    more = templates.extract(pages)
    assert more.columns == [*pages.columns, "text_", "n_chars"]
    assert {r.page_id: r.text_ for r in more.collect()} == want


def test_copies_and_repeated_paragraphs_stay(spark):
    """A host whose pages are copies, or share a paragraph, loses nothing of them."""
    rng = random.Random(14)
    page = semantic(rng, [prose(rng, 30), "same"], "title")
    plain = "<html><body><div class=menu>Menu</div><div><h1>t</h1><p>one and the same</p></div></body></html>"
    rows = [(i, "http://a/", page) for i in range(12)] + [(100 + i, "http://b/", plain) for i in range(12)]
    got = templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r.text for r in got if r.page_id < 100}) == 1 and got[0].text.startswith("title") and got[0].text.endswith("same")
    assert {r.text for r in got if r.page_id >= 100} == {"t one and the same"}


def test_odd_pages(spark):
    rng = random.Random(15)
    long = " ".join(f"<p>{prose(rng, 40)}</p>" for _ in range(3000))
    odd = ["", None, "plain  text\n&lt;b&gt;", "<p", "<p>a<p>b<br>c", "x < y <!-- z", "<!-->a<!-- b -->c", "<script>a", "<div class='ad'>only", "<a href=\"x>y\">link</a>", "<form><p>all in a form</p></form>", "</div></p>end", f"<article>{long}</article>", "<div>" * 3000 + "deep", "<p title='a>b\">c</p>", "&am;&amp&#65;&#x42;&nbsp;.", "<style>x</style><nav>menu</nav>", "<p hidden>no</p>yes", "<li>a<li>b", "<td>a<td>b<tr><td>c", "<article class=comment>c</article><main>m<article>n</article></main>"]
    want = ["", "", "plain text <b>", "", "a b c", "x < y", "ac", "", "only", "link", "all in a form", "end", None, "deep", None, "&am;&AB .", "", "yes", "a b", "a b c", "n"]
    rows = [(i, None if i % 2 else f"http://h{i}/", h) for i, h in enumerate(odd)] + [(None, None, "<p>x"), (3, "u", "<p>x"), (3, "u", "<p>x")]
    got = templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    texts = {r.page_id: r.text for r in got if r.page_id not in (None, 3)}
    assert {i: texts[i] for i, w in enumerate(want) if w is not None and i != 3} == {i: w for i, w in enumerate(want) if w is not None and i != 3}
    assert len(texts[12].split()) == 120_000 and all(r.n_chars == len(r.text) for r in got)
    assert templates.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_as_vectors_written_out(spark, made):
    rows, _ = made
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    parsed = templates.parsed_pages(pages).persist()
    tokens = templates.frequent_tokens(parsed)
    vectors, sequences = defaultdict(dict), defaultdict(list)
    for r in parsed.collect():
        sequences[r.hk].append(r.sequence)
        for t, n in Counter(r.sequence).items():
            vectors[r.hk, t][r.page_id] = n
    kept = {k: tuple(sorted(v.items())) for k, v in vectors.items() if len(v) > 1 and len(v) * templates.SHARE >= len(sequences[k[0]])}
    groups = defaultdict(set)
    for (hk, t), v in kept.items():
        groups[hk, v].add(t)
    got = defaultdict(set)
    for r in tokens.collect():
        got[r.hk, r.lo, r.hi].add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))

    def ordered(hk, members, root):
        orders, slots = set(), set()
        for s in sequences[hk]:
            own = [t for t in s if t in members]
            if not own:
                continue
            m = len(set(own))
            orders.add(tuple(own[:m]) if own == own[:m] * (len(own) // m) else None)
            slot = None
            for t in s:
                slot = t if t in root else slot
                if t in members and members != root:
                    slots.add(slot)
        return len(members) > 1 and len(orders) == 1 and None not in orders and len(slots) <= 1

    want = {(hk, tuple(sorted(m))) for (hk, v), m in groups.items() if ordered(hk, m, next(x for (h, _), x in groups.items() if h == hk and 0 in x))}
    valid = {(r.hk, tuple(sorted(got[r.hk, r.lo, r.hi]))) for r in templates.valid_classes(parsed, tokens).collect()}
    assert valid == want and len(valid) >= 3


def test_names_that_say_what_is_no_article():
    page = "<article><h1>t</h1><p>a</p>{}<p>b</p></article>"
    for odd in ("<div class=adsbygoogle>x</div>", "<ol class=commentlist><li>x</ol>", "<div role=alert>x</div>", "<section id=userComments><p>x</section>", "<p class='cookie-bar'>x</p>", "<span class=ad>x</span>", "<nav>x</nav>", "<aside>x</aside>"):
        assert [b.text for b in markup.parsed(page.format(odd)).blocks if not b.apart] == ["t", "a", "b"], odd
    for good in ("<div class=adventure>x</div>", "<div class='no-comments'>x</div>", "<figure><figcaption>x</figcaption></figure>", "<header>x</header>", "<details><summary>x</summary></details>"):
        assert [b.text for b in markup.parsed(page.format(good)).blocks if not b.apart] == ["t", "a", "x", "b"], good


def test_wrapper_with_a_bad_name_keeps_its_article():
    page = markup.parsed("<div class='page with-sidebar'><div class=banner>x<article><p>text</p></article></div></div>")
    assert [(b.text, b.apart) for b in page.blocks] == [("x", 1), ("text", 0)]
