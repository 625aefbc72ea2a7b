"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

from __future__ import annotations

import hashlib

import pytest
from compare import duck_rows, spark_rows

import corpus_pipeline
from wirepost.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(duck, queries.ORACLES[name])


def test_pipeline_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    from test_nearcopies import brute_kept
    from test_operators import brute_contaminated

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_dedup", "decontaminate", "tokens"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    good = stages["quality"](spark, docs, sf_dir).persist()
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    clean = [i for i, q in quality.items() if q == 1]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean)

    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    seen, want = set(), []
    for r in rows:
        ls, cover = (r.text or "").split("\n"), set()
        for i in range(len(ls) - 2):
            if tuple(ls[i : i + 3]) in seen:
                cover |= {i, i + 1, i + 2}
            seen.add(tuple(ls[i : i + 3]))
        text = "\n".join(x for i, x in enumerate(ls) if i not in cover)
        want.append((r.doc_id, text, len(text) if cover else r.n_chars))
    thin = stages["lines"](spark, good, sf_dir).persist()
    assert thin.columns == columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in thin.collect()) == want

    kept = set(brute_kept([(i, t) for i, t, _ in want], 0.8))
    stays = [(i, t) for i, t, _ in want if i in kept]
    single = stages["near_dedup"](spark, thin, sf_dir).persist()
    assert sorted((r.doc_id, r.text) for r in single.collect()) == stays

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, *_ in brute_contaminated(stays, items)}
    final = stages["decontaminate"](spark, single, sf_dir).persist()
    assert final.columns == columns
    assert sorted(r.doc_id for r in final.collect()) == [i for i, _ in stays if i not in dirty]

    library = Tokenizer.from_file(queries.vocabulary())
    ids_of = {i: library.encode(t, add_special_tokens=False).ids for i, t in stays if i not in dirty}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tokens = {(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids_of.items()}
    assert {tuple(r) for r in stages["tokens"](spark, final, sf_dir).collect()} == tokens
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == tokens


def odd_tables(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, dk string, root string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, texts without words, and columns with names that the operators use."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "one two three", "en", "s", 13, "x", "y"), (1, "one two three", "en", "s", 13, "x", "y"), (None, None, None, None, None, None, None), (2, "", None, None, 0, None, "z")]
    rows += [(3, long, "en", "s", len(long), "x", "y"), (4, long + " more", "en", "s", 1, "x", "y"), (None, "is alpha beta gamma delta epsilon zeta eta", "en", "s", None, "x", "y")]
    odd_tables(spark, tmp_path, rows)
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert [i for i, _ in got] == [1, 2, 3]
    assert got[1][1] == 0 and got[2][1] > 30_000


def test_pipeline_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
